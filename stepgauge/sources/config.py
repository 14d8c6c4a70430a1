"""Settings: plain dictionaries on the driver, looked up by path and checked."""

from __future__ import annotations

import json
from collections.abc import Iterable
from string import Formatter, Template
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepgauge.functions.text import STRATEGIES
from stepgauge.sources.trees import load_tagged


class SettingsError(ValueError):
    """A setting that can't be used."""


# Weights of a candidate's fidelity, thresholds and templates that must be there.
RANKING_WEIGHTS = {"formula_fidelity": 0.30, "source_coverage": 0.30, "non_hallucination": 0.20, "atom_completeness": 0.10, "non_duplication": 0.10}
TIE_MARGIN = 0.03
MATCH_THRESHOLD, MATRIX_THRESHOLD = 0.415, 0.75
JUDGE_LOW, JUDGE_HIGH = 0.375, 1.0
OUTPUT_MODES = ("plain_text", "yaml")
CONVERSION_TEMPLATES = ("per_question_conversion", "repair")


def load(path: str) -> dict:
    """A YAML or JSON file that holds a mapping."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    data = json.loads(text) if path.endswith(".json") else load_tagged(text)
    if not isinstance(data, dict):
        raise SettingsError(f"{path} must hold a mapping")
    return data


def lookup(settings: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path, or the default where the path ends early."""
    at: Any = settings
    for name in path.split("."):
        if not isinstance(at, dict) or name not in at:
            return default
        at = at[name]
    return at


def chosen(given: Any, settings: dict, path: str, default: Any = None) -> Any:
    """What the command line gives, else the settings, else the default."""
    return given if given is not None else lookup(settings, path, default)


def names(settings: dict, path: str) -> list[str]:
    """A list of names; one name counts as a list."""
    found = lookup(settings, path) or []
    return [found] if isinstance(found, str) else [str(x) for x in found]


def accepts(column: Column, wanted: Iterable[str]) -> Column:
    """A filter in which no names mean all."""
    wanted = list(wanted)
    return column.isin(*wanted) if wanted else F.lit(True)


def weights(settings: dict) -> dict[str, float]:
    """The ranking's weights: defaults with what is set; none negative or unknown, not all 0."""
    own = lookup(settings, "ranking.weights") or {}
    if unknown := sorted(set(own) - set(RANKING_WEIGHTS)):
        raise SettingsError(f"unknown ranking weights: {', '.join(unknown)}")
    out = RANKING_WEIGHTS | {k: float(v) for k, v in own.items()}
    if min(out.values()) < 0 or sum(out.values()) <= 0:
        raise SettingsError("ranking weights must not be negative and must have a positive sum")
    return out


def enabled_models(settings: dict) -> list[dict]:
    """The models that are not switched off."""
    found = [m for m in settings.get("models", []) if m.get("enabled", True)]
    if not found:
        raise SettingsError("no model is enabled")
    return found


def one_of(values: Iterable[str], known: Iterable[str], what: str) -> None:
    if wrong := sorted(set(values) - set(known)):
        raise SettingsError(f"unknown {what}: {', '.join(wrong)}")


def check_generation(settings: dict) -> None:
    """Prompt types, output modes, templates of each language, and outputs that would fall on one path."""
    types, modes = names(settings, "input.filters.prompt_types") or list(STRATEGIES), names(settings, "output_modes") or ["plain_text"]
    one_of(types, STRATEGIES, "prompt types")
    one_of(modes, OUTPUT_MODES, "output modes")
    for language, prompts in (lookup(settings, "prompts.languages") or {}).items():
        if missing := [t for t in types if t not in (prompts.get("strategies") or {})] + [k for k in ("common_header",) if k not in prompts]:
            raise SettingsError(f"prompts of {language} lack: {', '.join(missing)}")
    where = str(lookup(settings, "output.directory_template", "{mode}/{model}/{language}/{variation}")) + str(lookup(settings, "output.filename_template", "pc{pc}_q{exercise}{suffix}"))
    if len(types) > 1 and "{prompt_type" not in where:
        raise SettingsError("several prompt types would be written to one path; the templates need {prompt_type} or {prompt_type_abbrev}")


def check_conversion(settings: dict) -> None:
    """The conversion's templates, of each language."""
    for language, prompts in (lookup(settings, "prompts.languages") or {}).items():
        if missing := [k for k in CONVERSION_TEMPLATES if k not in prompts]:
            raise SettingsError(f"prompts of {language} lack: {', '.join(missing)}")


def prompts_for(settings: dict, language: str) -> dict:
    found = lookup(settings, f"prompts.languages.{language}")
    if not isinstance(found, dict):
        raise SettingsError(f"no prompts for {language}")
    return found


def by_language(language: Column, table: dict[str, float] | None, fallback: float, given: float | None = None) -> Column:
    """A threshold: the command line's, else the language's, else the fallback."""
    if given is not None:
        return F.lit(float(given))
    out = F.lit(float(fallback))
    for name, value in sorted((table or {}).items()):
        out = F.when(language == name, F.lit(float(value))).otherwise(out)
    return out


def judge_band(settings: dict, language: Column, low: float | None = None, high: float | None = None) -> tuple[Column, Column]:
    """The scores that go to the judge, of each language; a band that ends before it begins is an error."""
    table = lookup(settings, "judge.thresholds") or {}
    ends = {"low": (low, lookup(settings, "judge.low_threshold", JUDGE_LOW)), "high": (high, lookup(settings, "judge.high_threshold", JUDGE_HIGH))}
    value = lambda end, lang: float(ends[end][0] if ends[end][0] is not None else (table.get(lang) or {}).get(end, ends[end][1]))
    for lang in [*table, None]:
        if value("low", lang) > value("high", lang):
            raise SettingsError(f"the judge's band of {lang or 'other languages'} ends before it begins")
    pick = lambda end: by_language(language, {k: v[end] for k, v in table.items() if end in v}, ends[end][1], ends[end][0])
    return pick("low"), pick("high")


def formatted(template: str, values: dict[str, Column]) -> Column:
    """A path template with {name} filled in from columns."""
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in values:
                raise SettingsError(f"unknown name in a path template: {name}")
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def filled(template: str, values: dict[str, str]) -> str:
    """A prompt template with $name filled in, in one pass."""
    return Template(template).safe_substitute(values)

