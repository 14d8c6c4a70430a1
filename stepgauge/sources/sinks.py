"""Writers.

Tables are written by Spark, whose commit leaves whole files or none.  Files of
one row each are written by the executors that hold the rows, to a store that
all of them reach, under a temporary name and then renamed; a task that runs
again writes the same file.  Reports for people are small and written by the
driver in the same way.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgauge.functions import text as T
from stepgauge.schemas import BEST_COLUMNS, COVERAGE_COLUMNS, MATRIX_COLUMNS, ORDER_COLUMNS, STATEMENT_COLUMNS
from stepgauge.sources import files, listing
from stepgauge.sources.config import formatted
from stepgauge.sources.listing import located
from stepgauge.sources.scratch import kept
from stepgauge.sources.trees import dumped


def rendered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows as a report has them: columns in order (those that aren't there empty), nulls empty, True and False, six digits."""
    kinds = dict(rows.dtypes)

    def cell(name: str) -> Column:
        c = F.col(f"`{name}`") if name in kinds else F.lit(None).cast("string")
        kind = kinds.get(name, "string")
        c = F.initcap(c.cast("string")) if kind == "boolean" else F.format_string("%.6f", c) if kind == "double" else c.cast("string")
        present = F.col(f"`{name}`").isNotNull() if name in kinds else F.lit(False)
        return F.when(present, c).otherwise("").alias(name)

    return rows.select(*map(cell, columns))


def write_csv(rows: DataFrame, path: str, columns: list[str], files: int | None = None) -> None:
    """A report as CSV with a header; ``files=1`` for one that people open."""
    out = rendered(rows, columns)
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_by_language(rows: DataFrame, root: str) -> None:
    """A statement inventory, a folder for each language; a statement without one is an error."""
    checked = F.when(F.coalesce("language", F.lit("")) == "", F.raise_error(F.lit("a statement has no language"))).otherwise(F.col("language"))
    out = rendered(rows.withColumn("language", checked), STATEMENT_COLUMNS)
    out.write.mode("overwrite").partitionBy("language").option("header", True).option("emptyValue", "").option("escape", '"').csv(root)


def write_text(path: str, text: str, overwrite: bool = True) -> bool:
    """A file, whole or not at all; false if it is there and may not be replaced."""
    if os.path.exists(path) and not overwrite:
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.tmp")
    with open(temporary, "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(temporary, path)
    return True


def write_yaml(path: str, data: object, overwrite: bool = True) -> bool:
    return write_text(path, dumped(data), overwrite)


def exported(rows: DataFrame, root: str, target: str = "target", text: str = "text", overwrite: bool = True) -> DataFrame:
    """A file for each row, by its target path below root; target and status ('written', or 'skipped' if it was there)."""
    folder = located(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            status = []
            for name, body in zip(batch.column("target").to_pylist(), batch.column("text").to_pylist(), strict=True):
                path = f"{base}/{name}"
                if not overwrite and store.get_file_info(path).type != arrow_fs.FileType.NotFound:
                    status.append("skipped")
                    continue
                parent, _, last = path.rpartition("/")
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                temporary = f"{parent}/.{last}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(temporary) as out:
                    out.write((body or "").encode())
                store.move(temporary, path)
                status.append("written")
            yield pa.RecordBatch.from_arrays([batch.column("target"), pa.array(status, pa.string())], ["target", "status"])

    return kept(rows.select(F.col(target).alias("target"), F.col(text).alias("text")).mapInArrow(run, "target string, status string"), "exported")


def export(rows: DataFrame, root: str, target: str = "target", text: str = "text", overwrite: bool = True) -> dict[str, int]:
    """``exported``; counts of those written and those left as they are."""
    return {"written": 0, "skipped": 0} | {r[0]: r[1] for r in exported(rows, root, target, text, overwrite).groupBy("status").count().collect()}


def existing(spark: SparkSession, root: str) -> DataFrame:
    """target: the files below root, by their path below it; none if there is no such folder."""
    if listing.reachable(root):
        found = listing.listed(spark, root)
    else:
        try:
            found = files.texts(spark, root)
        except files.ScanError:
            found = None
    return spark.createDataFrame([], "target string") if found is None else found.select(F.col("path").alias("target"))


def removed(targets: DataFrame, root: str) -> int:
    """How many of the target paths there were; they are deleted."""
    folder = located(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            gone = [n for n in batch.column("target").to_pylist() if store.get_file_info(f"{base}/{n}").type != arrow_fs.FileType.NotFound]
            for name in gone:
                store.delete_file(f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], ["target"])

    return kept(targets.select("target").distinct().mapInArrow(run, "target string"), "removed").count()


def synchronized(rows: DataFrame, root: str, known: DataFrame, overwrite: bool = True) -> dict[str, int]:
    """``export``, after which those of known(target) that have no row are deleted."""
    done = exported(rows, root, overwrite=overwrite)
    count = {"written": 0, "skipped": 0} | {r[0]: r[1] for r in done.groupBy("status").count().collect()}
    return count | {"removed": removed(known.join(done, "target", "left_anti"), root)}


def write_error_report(path: str, summary: dict, failed: list[dict]) -> None:
    """A report of failed jobs; with none, an older report goes."""
    if failed:
        write_yaml(path, {"summary": summary, "failed_jobs": failed})
    elif os.path.exists(path):
        os.remove(path)


def plain_text(answers: DataFrame) -> DataFrame:
    """text of each job's answers (question, answer in order of ``subquestion``), with its header."""
    job = [c for c in ("pc", "q", "model", "language", "variation", "strategy", "mode") if c in answers.columns]
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("subquestion", "question", "answer"))), lambda x: F.concat(F.lit("Question "), x["subquestion"].cast("string"), F.lit(":\n"), x["question"], F.lit("\n\nAnswer:\n"), x["answer"], F.lit("\n")))
    head = F.concat(F.lit("Exercise: pc"), "pc", F.lit("_q"), "q", F.lit("\nModel: "), "model", F.lit("\nVariation: "), "variation", F.lit("\nPrompt type: "), "strategy", F.lit("\n"))
    rows = answers.groupBy(*job).agg(F.array_join(blocks, "\n").alias("body"))
    return rows.select(*job, F.concat(F.regexp_replace(F.concat(head, F.lit("\n"), "body"), r"\s+\z", ""), F.lit("\n")).alias("text"))


def direct_yaml(answers: DataFrame) -> DataFrame:
    """text (YAML) of each job whose answers are YAML already, or the error of its first bad one."""
    job = [c for c in ("pc", "q", "model", "language", "variation", "strategy", "mode") if c in answers.columns]
    rows = answers.groupBy(*job).agg(F.transform(F.array_sort(F.collect_list(F.struct("subquestion", "answer"))), lambda x: x["answer"]).alias("answers"))

    def one(answers: pa.Array) -> pa.Array:
        from stepgauge.operators import generate

        return pa.array([dict(zip(("text", "error"), generate.direct_yaml(a), strict=True)) for a in answers.to_pylist()], pa.struct([("text", pa.string()), ("error", pa.string())]))

    return rows.select(*job, F.arrow_udf(one, "text string, error string")("answers").alias("__y")).select(*job, "__y.*")


def target(template: str, rows: DataFrame, **values: Column) -> DataFrame:
    """rows with their target path; two rows on one path are an error when they are written."""
    own = {c: F.col(c) for c in rows.columns} | values | ({"model": T.path_safe(F.col("model"))} if "model" in rows.columns else {})
    return rows.withColumn("target", formatted(template, own))


def collisions(rows: DataFrame) -> DataFrame:
    """Target paths that several rows have."""
    return rows.groupBy("target").count().where("count > 1")


def group_folder(root: str, language: str, variation: str, judged: bool) -> str:
    return f"{root}/{language}/{variation}/{'with_judge' if judged else 'embedding_only'}"


def finished_groups(spark: SparkSession, root: str, judged: bool) -> DataFrame:
    """language, variation of the groups whose report is there."""
    kind = "with_judge" if judged else "embedding_only"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*/{kind}/evaluation_summary.csv")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    found = [tuple(str(x.getPath()).split("/")[-4:-2]) for x in there]
    return spark.createDataFrame(found, "language string, variation string")


def write_group(result: dict[str, DataFrame], root: str, language: str, variation: str, judged: bool) -> str:
    """The report bundle of one group: matrices, best matches, order constraints and summaries."""
    folder = group_folder(root, language, variation, judged)
    own = lambda name: result[name].where((F.col("language") == language) & (F.col("variation") == variation))
    keys = ["call1_model", "exercise", "strategy"]
    for name, file, columns in (("matrix", "atom_alignment_matrix", MATRIX_COLUMNS), ("best_matches", "atom_alignment_best_matches", BEST_COLUMNS), ("order", "d2_order_constraints", ORDER_COLUMNS)):
        rendered(own(name), [*keys, *columns]).write.mode("overwrite").partitionBy("call1_model", "exercise").option("header", True).option("emptyValue", "").csv(f"{folder}/matrices/{file}.csv")
    for name, file in (("summary", "evaluation_summary"), ("by_model", "evaluation_by_model"), ("by_model_strategy", "evaluation_by_model_strategy")):
        rows = own(name)
        write_csv(rows, f"{folder}/{file}.csv", [c for c in rows.columns if c not in ("language", "variation") or name == "summary"], 1)
    write_csv(own("coverage"), f"{folder}/evaluation_coverage.csv", COVERAGE_COLUMNS, 1)
    return folder
