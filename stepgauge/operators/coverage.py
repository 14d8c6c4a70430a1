"""Expected cases, found ones, jobs to run and jobs done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgauge.schemas import CASE


def product(*axes: DataFrame) -> DataFrame:
    """All combinations of a few short lists (models, languages, strategies); a list of 1 GB or so would be a mistake."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(axis)
    return out


def expected(models: DataFrame, languages: DataFrame, variations: DataFrame, strategies: DataFrame, exercises: DataFrame) -> DataFrame:
    """The cases there should be: exercises are those of the case's language."""
    return product(models, languages, variations, strategies).join(exercises.distinct(), "language").select(*CASE)


def axes(found: DataFrame, exercises: DataFrame, wanted: dict[str, list[str]]) -> list[DataFrame]:
    """The lists behind ``expected``: those that are set, else what is found."""
    spark = found.sparkSession
    out = []
    for plural, column in (("models", "call1_model"), ("languages", "language"), ("variations", "variation"), ("strategies", "strategy")):
        names = wanted.get(plural)
        out.append(spark.createDataFrame([(n,) for n in names], f"{column} string") if names else found.select(column).distinct())
    return [*out, exercises.select("language", "exercise")]


def found_or_missing(wanted: DataFrame, found: DataFrame, keys: list[str], path: str = "prediction_path") -> DataFrame:
    """wanted with a status and the path of what was found (of several the last)."""
    one = found.groupBy(*keys).agg(F.max(path).alias(path))
    out = wanted.join(one, keys, "left")
    return out.select(F.when(F.col(path).isNull(), "missing").otherwise("found").alias("status"), *keys, path)


def still_to_do(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """jobs without those that are done."""
    return jobs.join(done, keys, "left_anti")


def counters(log: DataFrame, keys: list[str], status: str = "status", states: tuple[str, ...] = ("written", "skipped", "failed")) -> DataFrame:
    """How many jobs went which way."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("jobs"), *[F.count_if(F.col(status) == s).alias(s) for s in states])
