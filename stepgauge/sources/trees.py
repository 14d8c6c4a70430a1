"""Proof trees in YAML or JSON: loaded safely, flattened to atoms, checked and repaired.

YAML has to be parsed in Python; one call per text turns it into a row of the
``EXERCISE`` schema, and everything after that is done on columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgauge.functions.text import fenced, repaired_yaml
from stepgauge.schemas import ARROW_EXERCISE, ATOM_FIELDS, EXERCISE


class _Loader(yaml.SafeLoader):
    """Plain data, and the tag that marks an unordered set."""


_Loader.add_constructor("tag:yaml.org,2002:python/tuple", lambda loader, node: tuple(loader.construct_sequence(node, deep=True)))


class _Dumper(yaml.SafeDumper):
    """Writes tuples under the tag of unordered sets; never aliases."""

    def ignore_aliases(self, data: Any) -> bool:
        return True


_Dumper.add_representer(tuple, lambda dumper, data: dumper.represent_sequence("tag:yaml.org,2002:python/tuple", data))


def load_tagged(text: str) -> Any:
    return yaml.load(text, Loader=_Loader)  # noqa: S506  a subclass of SafeLoader


def dumped(data: Any) -> str:
    """YAML in the order given, four blanks deep, letters as they are."""
    return yaml.dump(data, Dumper=_Dumper, allow_unicode=True, sort_keys=False, default_flow_style=False, indent=4)


# -- faster readers of what is plain; tests hold them against the loader above

class _NotPlain(ValueError):
    """A text that the loader has to read."""


#: Characters that are printable and break no line but the plain one; tabs have places of their own.
_PLAIN = re.compile("[\n\x20-\x7e\xa0-\u2027\u2030-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]*\\Z")
#: Where the compiled parser takes what the loader refuses, or reads it in another way: tags, marks of keys, comments behind a block's sign.
_APART = re.compile(r"!(?!!python/tuple )(?<!!!)|\?[ \n]|\?\Z|[|>][-+0-9]*#")
_LONGEST_KEY = 500


class _Quick(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """``_Loader`` with the compiled parser, if there is one."""


_Quick.add_constructor("tag:yaml.org,2002:python/tuple", lambda loader, node: tuple(loader.construct_sequence(node, deep=True)))


def _never(found: str) -> None:
    raise _NotPlain(found)


def _mapping(pairs: list[tuple[str, Any]]) -> dict:
    if any(len(k) > _LONGEST_KEY for k, _ in pairs):
        raise _NotPlain("a long key")
    return dict(pairs)


def documents(text: str) -> list[Any]:
    """All documents of a text: strings in JSON as JSON, plain YAML by the compiled parser, the rest, and all faults, by the loader."""
    if _PLAIN.match(text):
        if text.startswith("{") and "\n" not in text and "\\u" not in text:
            try:
                return [json.loads(text, object_pairs_hook=_mapping, parse_int=_never, parse_float=_never, parse_constant=_never)]
            except (ValueError, RecursionError):  # no JSON, or not plain
                pass
        if not _APART.search(text):
            try:
                return list(yaml.load_all(text, Loader=_Quick))  # noqa: S506
            except (yaml.YAMLError, ValueError, TypeError):  # the loader tells what is wrong
                pass
    return list(yaml.load_all(text, Loader=_Loader))  # noqa: S506


def first_mapping(text: str) -> tuple[dict | None, str | None]:
    """(the first document that isn't empty, None), or (None, what is wrong with it)."""
    try:
        found = [x for x in documents(text) if x is not None]
    except (yaml.YAMLError, ValueError, TypeError) as wrong:
        return None, str(wrong)
    if not found:
        return None, "YAML response did not contain any non-empty document."
    if not isinstance(found[0], dict):
        return None, "Top-level YAML value must be a mapping."
    return found[0], None


def is_atom(value: Any) -> bool:
    return isinstance(value, dict) and all(k in value for k in ATOM_FIELDS)


def atoms_in(tree: Any, into_mappings: bool = False, steps: tuple = ()) -> Iterator[tuple[tuple, dict]]:
    """(steps, atom) of each atom, depth first.  Other mappings are passed over, or looked into."""
    if is_atom(tree):
        yield steps, tree
    elif isinstance(tree, (list, tuple)):
        kind = "set" if isinstance(tree, tuple) else "list"
        for child, below in enumerate(tree, 1):
            yield from atoms_in(below, into_mappings, (*steps, (kind, child)))
    elif into_mappings and isinstance(tree, dict):
        for below in tree.values():
            yield from atoms_in(below, True, steps)


def texts_of(value: Any) -> list[str]:
    """An atom field's texts: a text alone is one; what is no text is left out."""
    if isinstance(value, str):
        return [value]
    return [x for v in value for x in texts_of(v)] if isinstance(value, (list, tuple)) else []


def flat_atoms(tree: Any) -> list[dict]:
    out = []
    for n, (steps, atom) in enumerate(atoms_in(tree), 1):
        number = atom.get("strength")
        out.append({"atom_index": n, "steps": [{"kind": k, "child": c} for k, c in steps]} | {f: texts_of(atom[f]) for f in ATOM_FIELDS} | {"strength": float(number) if isinstance(number, (int, float)) else None})
    return out


# Where a reference answer stands, in order.
ANSWER_KEYS = ("solution", "ground_truth", "answer", "expected_answer", "atoms")


def exercise_row(data: dict, answers: bool = False) -> dict:
    """An exercise's or prediction's mapping as a row of the EXERCISE schema; ``answers``: with the reference answers, as YAML if they are trees."""
    subs = data.get("subquestions")
    rows = []
    for sub in subs if isinstance(subs, list) else []:
        sub = sub if isinstance(sub, dict) else {}
        answer = next((a for k in ANSWER_KEYS if (a := sub.get(k)) not in (None, "", [], ())), None) if answers else None
        rows.append({"question": str(sub.get("question") or ""), "assumptions": texts_of(sub.get("assumptions") or []), "answer": answer if isinstance(answer, str) or answer is None else dumped(answer).strip(), "atoms": flat_atoms(sub.get("atoms"))})
    return {"context": str(data.get("context") or ""), "assumption_global": texts_of(data.get("assumption_global") or []), "subquestions": rows, "error": None}


# -- repair and validation

# The sentences of the faults below, which reports and prompts for repairs hold word by word.
_NEEDED, _ALLOWED = set(ATOM_FIELDS), {*ATOM_FIELDS, "strength"}
# Keys of a generic configuration, which no conversion has.
FORBIDDEN = ["description", "name", "parameters", "scenarios", "version"]


def repaired(tree: Any) -> Any:
    """The tree with atoms that were split into several mappings put together again."""
    if isinstance(tree, dict):
        return {k: repaired(v) for k, v in tree.items()}
    if not isinstance(tree, (list, tuple)):
        return tree
    out: list = []
    open_at = None  # where in out the atom stands that may still take keys
    for item in map(repaired, tree):
        keys = set(item) if isinstance(item, dict) else set()
        if not (keys & _NEEDED and keys <= _ALLOWED and not keys >= _NEEDED):
            out.append(item)
            open_at = None
            continue
        if open_at is None or keys & set(out[open_at]):
            out.append(dict(item))
            open_at = len(out) - 1
        else:
            out[open_at].update(item)
        if set(out[open_at]) >= _NEEDED:
            open_at = None
    return tuple(out) if isinstance(tree, tuple) else out


def atom_faults(atom: Any, at: str) -> Iterator[str]:
    missing, more = [k for k in ATOM_FIELDS if k not in atom], sorted(map(str, set(atom) - _ALLOWED))
    if missing:
        yield f"{at} is missing atom key(s): {', '.join(missing)}."
        return
    if more:
        yield f"{at} has unexpected key(s): {', '.join(more)}."
    for field in ATOM_FIELDS:
        if not isinstance(atom[field], list):
            yield f"{at}.{field} must be a list of strings."
            return
        yield from (f"{at}.{field}[{n}] must be a string." for n, x in enumerate(atom[field], 1) if not isinstance(x, str))
    if not atom["arguments"]:
        yield f"{at}.arguments must contain at least one argument."
    if "strength" in atom and not isinstance(atom["strength"], (int, float)):
        yield f"{at}.strength must be numeric."


def tree_faults(tree: Any, at: str) -> Iterator[str]:
    if isinstance(tree, dict):
        yield from atom_faults(tree, at)
    elif isinstance(tree, (list, tuple)):
        for n, below in enumerate(tree, 1):
            yield from tree_faults(below, f"{at}[{n}]")
    else:
        yield f"{at} must be an atom mapping, list, or !!python/tuple."


def exercise_faults(data: dict, expected: int | None = None) -> Iterator[str]:
    """What is wrong with a whole conversion, in order."""
    if bad := [k for k in FORBIDDEN if k in data]:
        yield f"Converted YAML looks like a generic benchmark configuration; forbidden top-level key(s): {', '.join(bad)}."
    subs = data.get("subquestions")
    if "subquestions" not in data:
        yield "Converted YAML must contain a top-level 'subquestions' key."
    elif not isinstance(subs, list):
        yield "Top-level 'subquestions' value must be a list."
    else:
        if expected is not None and len(subs) != expected:
            # fixed wording: goes back to the model that is asked for a repair
            yield f"Expected exactly {expected} top-level subquestion item(s), because the Call 1 source contains {expected} Question block(s), but converted YAML contains {len(subs)}. Do not split proof steps into extra top-level subquestions; keep them inside the atoms structure for the corresponding Question block."
        for n, sub in enumerate(subs, 1):
            if not isinstance(sub, dict):
                yield f"subquestions[{n}] must be a mapping."
            elif "atoms" not in sub:
                yield f"subquestions[{n}] must contain an 'atoms' key."
            else:
                yield from tree_faults(sub["atoms"], f"subquestions[{n}].atoms")


def single_question(data: dict) -> tuple[Any, str | None]:
    """(the atoms of a conversion of one question, None), or (None, the first fault)."""
    at, holder = "atoms", data
    if "atoms" not in data:
        if "subquestions" not in data:
            return None, "Single-question conversion must contain an 'atoms' key."
        subs = data["subquestions"]
        if not isinstance(subs, list):
            return None, "Top-level 'subquestions' value must be a list."
        if len(subs) != 1:
            return None, "Single-question conversion must contain exactly one subquestions item when using the subquestions wrapper."
        if not isinstance(subs[0], dict):
            return None, "subquestions[1] must be a mapping."
        if "atoms" not in subs[0]:
            return None, "subquestions[1] must contain an 'atoms' key."
        at, holder = "subquestions[1].atoms", subs[0]
    fault = next(tree_faults(holder["atoms"], at), None)
    return (None, fault) if fault else (holder["atoms"], None)


# -- on columns

def once(parser):
    """A parser that no filter on what it says is pushed below, where it would parse each text a second time."""
    return parser.asNondeterministic()


def _empty(error: str) -> dict:
    return {"context": "", "assumption_global": [], "subquestions": [], "error": error}


def read_exercise(text: str | None, expected: int | None = None, check: bool = False, answers: bool = False) -> dict:
    """A text's row; ``check``: repaired and validated too.  What fails has its first fault as ``error``."""
    data, wrong = first_mapping(text or "")
    if data is None:
        return _empty(wrong or "")
    if check:
        data = repaired(data)
        wrong = next(exercise_faults(data, expected), None)
        if wrong:
            return _empty(wrong)
    return exercise_row(data, answers)


def parsed(texts: DataFrame, text: str = "text", expected: str | None = None, check: bool = False, answers: bool = False) -> DataFrame:
    """texts with the columns of EXERCISE in place of the text column."""
    def one(texts: pa.Array, expected: pa.Array) -> pa.Array:
        rows = [read_exercise(t.as_py(), n.as_py(), check, answers) for t, n in zip(texts, expected, strict=True)]
        return pa.array(rows, ARROW_EXERCISE)

    read = once(F.arrow_udf(one, EXERCISE))
    rest = [c for c in texts.columns if c not in (text, "context", "assumption_global", "subquestions", "error")]
    return texts.select(*rest, read(F.col(text), F.col(expected).cast("long") if expected else F.lit(None).cast("long")).alias("__e")).select(*rest, "__e.*")


def response_yaml(response: str = "text"):
    """The YAML of a generated response: out of its fence, with its slips put right."""
    return repaired_yaml(fenced(F.col(response)))


def from_json(text: str) -> dict:
    """A JSON exercise: sets are written as {"set": [..]}."""
    def sets(value: Any) -> Any:
        if isinstance(value, dict):
            return tuple(map(sets, value["set"])) if set(value) == {"set"} and isinstance(value["set"], list) else {k: sets(v) for k, v in value.items()}
        return [sets(v) for v in value] if isinstance(value, list) else value

    return sets(json.loads(text))


def atoms(exercises: DataFrame, keys: list[str]) -> DataFrame:
    """keys, subquestion_index and the columns of each atom; indices from 1."""
    subs = exercises.select(*keys, F.posexplode("subquestions").alias("__n", "__sub"))
    return subs.select(*keys, (F.col("__n") + 1).alias("subquestion_index"), F.inline("__sub.atoms"))


def path(subquestion, steps, set_name: str = "set"):
    """An atom's path in its exercise; the statement inventory writes sets as tuples."""
    step = lambda s: F.concat(F.lit("/"), F.when(s["kind"] == "set", F.lit(set_name)).otherwise(s["kind"]), F.lit("["), s["child"].cast("string"), F.lit("]"))
    return F.concat(F.lit("subquestions["), subquestion.cast("string"), F.lit("].atoms"), F.array_join(F.transform(steps, step), ""))
