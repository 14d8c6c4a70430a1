"""Scans: trees of text files as tables, with what their paths tell about them.

The executors list and read the files (``listing``); a store that Arrow doesn't
reach is read by Spark.  Paths are relative to the scan's root; a filter on what
a path tells is put before the file is read.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgauge.functions import text as T
from stepgauge.schemas import STATEMENT_COLUMNS
from stepgauge.sources import listing
from stepgauge.sources.config import accepts


class ScanError(ValueError):
    """A scan that finds nothing to read, or what must not be there twice."""


def texts(spark: SparkSession, root: str, glob: str | None = None, ordered: bool = False) -> DataFrame:
    """path (below root), text: each file below root whose name fits the glob, as one row; ``ordered``: by path.

    Files are found now, and read where their text is wanted.
    """
    if not listing.reachable(root):
        rows = _by_spark(spark, root, glob)
        return rows.orderBy("path") if ordered else rows
    found = listing.listed(spark, root, glob)
    if found is None:
        raise ScanError(f"can't read {root}")
    return listing.spread(found, ordered).select("path", listing.contents(root)("path").cast("string").alias("text"))


def _by_spark(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    """``texts`` of a store that only Spark reads, whose readers pass over empty files: these are listed by the driver."""
    base = re.sub(r"^\w+:/*", "/", root.rstrip("/"))
    try:
        rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    except AnalysisException as missing:
        raise ScanError(f"can't read {root}") from missing
    at = F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/*", "/")
    rows = rows.select(F.substring(at, F.lit(len(base) + 2), F.length(at)).alias("path"), F.col("value").alias("text"))
    if re.search(r"[*?\[\]{}]", root):
        return rows
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, empty = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while found.hasNext():
        file = found.next()
        if not file.getLen():
            path = re.sub(r"^\w+:/*", "/", file.getPath().toString())[len(base) + 1 :]
            if not any(map(listing.hidden, path.split("/"))) and (not glob or re.match(listing.glob_pattern(glob), path.rsplit("/", 1)[-1])):
                empty.append((path, ""))
    return rows.unionByName(spark.createDataFrame(empty, "path string, text string")) if empty else rows


def required(rows: DataFrame, what: str) -> DataFrame:
    """rows, or an error if there are none."""
    if rows.isEmpty():
        raise ScanError(f"found no {what}")
    return rows


def _part(pattern: str, k: int, c: str = "path") -> Column:
    """A group of a pattern that a whole path must fit; null if it doesn't, '' for an optional group that isn't there."""
    whole = rf"\A(?:{pattern})\z"
    return F.when(F.col(c).rlike(whole), F.regexp_extract(c, whole, k))


def _parts(rows: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """rows whose path fits, with a column for each group."""
    return rows.withColumns({n: _part(pattern, k) for k, n in enumerate(names, 1)}).where(F.col(names[0]).isNotNull())


# -- exercises

TEX_NAME = r"(?:.*/)?(pc[0-9]+_q[0-9]+)_([\p{L}]+)\.tex"


def downloaded_tex(spark: SparkSession, root: str) -> DataFrame:
    """path, text, name, language, target of downloaded exercises pc{n}_q{m}_{language}.tex."""
    rows = _parts(texts(spark, root, "pc*_q*_*.tex", ordered=True), TEX_NAME, ["name", "language"])
    return required(rows, f"exercises below {root}").withColumn("target", F.concat("language", F.lit("/"), "name", F.lit(".tex")))


def annotated_tex(spark: SparkSession, root: str) -> DataFrame:
    """path, text of annotated exercises, and where their YAML goes."""
    return texts(spark, root, "*.tex", ordered=True).withColumn("target", F.regexp_replace("path", r"\.tex$", ".yaml"))


EXERCISE_NAME = r"(?:([^/]+)/(?:.*/)?)?(pc([0-9]+)_q([0-9]+))\.(yaml|yml|json)"


def exercises(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """path, text, language, exercise, pc, q: exercise files of the languages (none: all); no folder: language 'unknown'."""
    rows = _parts(texts(spark, root, "pc*_q*.*"), EXERCISE_NAME, ["language", "exercise", "pc", "q", "kind"])
    rows = rows.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")))
    return required(rows.where(accepts(F.col("language"), languages or [])), f"exercises below {root}")


def inventory_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text, language, pc, exercise of all YAML files; what a path doesn't tell is ''."""
    rows = texts(spark, root, "*.{yaml,yml}")
    name = r"(?:.*/)?pc([0-9]+)_q([0-9]+)\.ya?ml"
    return rows.select(
        "path", "text",
        F.when(F.contains("path", F.lit("/")), F.split("path", "/")[0]).otherwise("").alias("language"),
        F.coalesce(_part(name, 1), F.lit("")).alias("pc"),
        F.coalesce(_part(name, 2), F.lit("")).alias("exercise"),
    ).withColumnRenamed("path", "source_file")


# -- generated answers, conversions, predictions

def _strategy(rows: DataFrame) -> DataFrame:
    """The prompt type: of the header, else of the file's abbreviation."""
    header = F.nullif(T.strip(F.regexp_extract("text", r"(?m)^Prompt type:(.*)$", 1)), F.lit(""))
    short = F.nullif("short", F.lit(""))
    name = F.coalesce(header, F.coalesce(T.strategy_name(short), short), F.lit("unknown"))
    return rows.withColumn("strategy", name).withColumn("strategy_abbreviation", F.coalesce(short, T.strategy_abbreviation(F.col("strategy")), F.lit("unknown"))).drop("short")


ANSWER_PATH = r"(?:(plain_text)/)?([^/]+)/([^/]+)/([^/]+)/(?:.*/)?(pc([0-9]+)_q([0-9]+))(?:_([A-Za-z0-9-]+))?\.txt"


def answers(spark: SparkSession, root: str, models: list[str] | None = None, languages: list[str] | None = None, variations: list[str] | None = None, strategies: list[str] | None = None, modes: list[str] | None = None) -> DataFrame:
    """Generated answers: path, text, call1_output_mode, call1_model, language, variation, exercise, pc, q, strategy, strategy_abbreviation.

    root is the folder of plain-text answers or the one above it; for each filter nothing means all.
    """
    rows = _parts(texts(spark, root, "pc*_q*.txt"), ANSWER_PATH, ["call1_output_mode", "call1_model", "language", "variation", "exercise", "pc", "q", "short"])
    if root.rstrip("/").rsplit("/", 1)[-1] != "plain_text":
        rows = rows.where("call1_output_mode = 'plain_text'")
    rows = rows.withColumn("call1_output_mode", F.lit("plain_text"))
    safe = [re.sub(r"[\/\\:\s]+", "-", m).strip("-") for m in models or []]
    rows = rows.where(accepts(F.col("call1_model"), safe) & accepts(F.col("language"), languages or []) & accepts(F.col("variation"), variations or []) & accepts(F.col("call1_output_mode"), modes or []))
    return required(_strategy(rows).where(accepts(F.col("strategy"), strategies or [])), f"answers below {root}")


CANDIDATE_PATH = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/(pc([0-9]+)_q([0-9]+))_([A-Za-z0-9-]+)\.ya?ml"


def candidates(spark: SparkSession, root: str, models: list[str] | None = None) -> DataFrame:
    """Conversions that compete: path, text, call1_model, call2_model, language, variation, exercise, pc, q, strategy_abbreviation."""
    rows = _parts(texts(spark, root, "pc*_q*.{yaml,yml}"), CANDIDATE_PATH, ["call1_model", "call2_model", "language", "variation", "exercise", "pc", "q", "strategy_abbreviation"])
    return rows.where(accepts(F.col("call2_model"), models or []))


PREDICTION_PATH = r"([^/.][^/]*)/([^/]+)/([^/]+)/(?:.*/)?(pc\d+_q\d+)(?:_(.+))?\.ya?ml"


def case_of(path: Column) -> dict[str, Column]:
    """What a prediction's path tells: model, language, variation, exercise, strategy ('' if none)."""
    whole = rf"\A(?:{PREDICTION_PATH})\z"
    return {n: F.when(path.rlike(whole), F.regexp_extract(path, whole, k)) for k, n in enumerate(["call1_model", "language", "variation", "exercise", "strategy"], 1)}


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """prediction_path, text and the case of each prediction; other files are passed over."""
    rows = texts(spark, root, "pc*.{yaml,yml}")
    rows = rows.withColumns(case_of(F.col("path"))).where("call1_model is not null")
    return required(rows.withColumnRenamed("path", "prediction_path"), f"predictions below {root}")


def ground_truth(spark: SparkSession, root: str) -> DataFrame:
    """gt_path, text, language, exercise of each annotated exercise."""
    rows = _parts(texts(spark, root, "pc*.{yaml,yml}"), r"([^/]+)/(pc[0-9]+_q[0-9]+)\.ya?ml", ["language", "exercise"])
    return rows.withColumnRenamed("path", "gt_path")


# -- calibration

def statement_csv(spark: SparkSession, path: str) -> DataFrame:
    """A statement inventory, all columns as text, with its row numbers as ``pos``.

    Columns go by the header's names, as a language's own folder has no column for it; one that isn't there is null, an empty cell is the empty text.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\0").csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in STATEMENT_COLUMNS], F.monotonically_increasing_id().alias("pos"))


def pair_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text, folder of {language}/formulation_pairs.yaml."""
    rows = _parts(texts(spark, root, "formulation_pairs.{yaml,yml,yxml}"), r"(?:.*/)?([^/]+)/formulation_pairs\.y.*ml", ["folder"])
    return required(rows, f"pair files below {root}")


def pairs_language(metadata: Column, source_files: Column, folder: Column) -> Column:
    """A pair file's language: what it says, else the one language of its statements' files, else its folder; an error if none tells."""
    found = F.array_distinct(F.filter(F.transform(source_files, lambda x: F.regexp_extract(x, r"(?:^|/)ground_truth/([^/]+)/", 1)), lambda x: x != ""))
    return F.coalesce(F.nullif(metadata, F.lit("")), F.when(F.size(found) == 1, found[0]), F.when(~folder.isin("evaluation", "data", ""), folder), F.raise_error(F.lit("a pair file doesn't tell its language")).cast("string"))


def one_per(rows: DataFrame, key: str, what: str) -> DataFrame:
    """rows, or an error if a key comes twice."""
    twice = rows.groupBy(key).count().where("count > 1").select(key).take(1)
    if twice:
        raise ScanError(f"{what} {twice[0][0]!r} comes twice")
    return rows
