"""Generation of answers and their conversion: jobs, outputs, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgauge.functions.text import question_blocks, strategy_abbreviation
from stepgauge.operators import coverage, generate
from stepgauge.sources import sinks
from stepgauge.sources.config import SettingsError
from stepgauge.sources.scratch import kept


def jobs(inputs: DataFrame, **axes: list[str]) -> DataFrame:
    """Each input with each value of the other lists (variations, strategies, modes, models).

    The lists are part of the plan, so no table is joined to another.
    """
    for name, values in axes.items():
        inputs = inputs.withColumn(name, F.explode(F.array(*map(F.lit, values)).cast("array<string>")))
    return inputs


def without_done(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose target is not there yet."""
    return coverage.still_to_do(rows, done, ["target"])


# Output modes and their files' endings.
SUFFIXES = {"plain_text": ".txt", "yaml": ".yaml"}


def answer_jobs(exercises: DataFrame, variations: list[str], strategies: list[str], models: list[str], directory: str = "{mode}/{model}/{language}/{variation}", file: str = "pc{pc}_q{exercise}_{prompt_type_abbrev}{suffix}", modes: list[str] | None = None) -> DataFrame:
    """Jobs of the first step with their target; an error if two have one."""
    rows = jobs(exercises, variation=variations, strategy=strategies, mode=modes or ["plain_text"], model=models)
    suffix = F.when(F.col("mode") == "yaml", SUFFIXES["yaml"]).otherwise(SUFFIXES["plain_text"])
    named = {"model1": F.col("model"), "exercise": F.col("q"), "prompt_type": F.col("strategy"), "prompt_type_abbrev": strategy_abbreviation(F.col("strategy")), "suffix": suffix}
    rows = sinks.target(f"{directory}/{file}", rows, **named)
    if not sinks.collisions(rows).isEmpty():
        raise SettingsError("several jobs would be written to one path")
    return rows


def run_answers(rows: DataFrame, generator: generate.Generator, prompts: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """(pc, q, model, language, variation, strategy, mode, text of each job that went well, the jobs that failed).

    Every prompt is sent once: the answers are written before they are used.
    """
    out = kept(generate.answers(rows, generator, prompts), "answers")
    good, failed = out.where("error is null"), out.where("error is not null").drop("subquestion", "question", "answer")
    if "mode" not in rows.columns:
        return sinks.plain_text(good), failed
    made = kept(sinks.direct_yaml(good.where("mode = 'yaml'")), "direct")
    texts = sinks.plain_text(good.where("mode <> 'yaml'")).unionByName(made.where("error is null").drop("error"))
    return texts, failed.unionByName(made.where("error is not null").select(failed.columns))


def conversion_jobs(answers: DataFrame, models: list[str]) -> DataFrame:
    """Jobs of the second step: each answer's blocks for each model."""
    return jobs(answers.withColumn("blocks", question_blocks(F.col("text"))).drop("text"), model=models)


def run_conversions(rows: DataFrame, generator: generate.Generator, prompts: dict[str, dict], repairs: int = 2) -> tuple[DataFrame, DataFrame]:
    """(conversions with their YAML, failed ones with the first fault); every prompt is sent once."""
    out = kept(generate.conversions(rows, generator, prompts, repairs), "conversions")
    return out.where("error is null"), out.where("error is not null")


def counted(every: DataFrame, skipped: DataFrame, failed: DataFrame) -> dict:
    """Counters of a run, in all and by output mode: what was there already, what failed, and the rest, which was written."""
    log = every.select("target", "mode").join(skipped.select("target", F.lit("skipped").alias("s")), "target", "left").join(failed.select("target", F.lit("failed").alias("f")), "target", "left")
    log = log.withColumn("status", F.coalesce("s", "f", F.lit("written")))
    modes = {r["mode"]: {k: r[k] for k in ("jobs", "written", "skipped", "failed")} for r in coverage.counters(log, ["mode"]).collect()}
    return {k: sum(m[k] for m in modes.values()) for k in ("jobs", "written", "skipped", "failed")} | {"by_mode": modes}
