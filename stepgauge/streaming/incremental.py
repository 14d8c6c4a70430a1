"""Evaluation of predictions as they arrive.

A file stream remembers what it has read, so each micro-batch holds the new
predictions alone; they are parsed and evaluated like any others and appended to
the tables, with the batch's number, so that a batch which runs twice replaces
its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepgauge.functions.vectors import Encoder
from stepgauge.plans.evaluation import evaluate
from stepgauge.sources import trees
from stepgauge.sources.files import case_of


def arriving(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of prediction_path, text and the case of each new prediction below root."""
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="pc*.{yaml,yml}")
    at = F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/*", "")
    rows = rows.select(F.substring(at, F.lit(len(base) + 2), F.length(at)).alias("path"), F.col("value").alias("text"))
    return rows.withColumns(case_of(F.col("path"))).where("call1_model is not null").withColumnRenamed("path", "prediction_path")


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``work`` on what has arrived, then stop."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start()


def evaluate_arrivals(spark: SparkSession, root: str, ground_truth: DataFrame, encoder: Encoder, out: str, checkpoint: str, tables: tuple[str, ...] = ("summary", "matrix")) -> StreamingQuery:
    """Evaluate new predictions and keep the tables below ``out``, a folder for each batch."""
    def work(batch: DataFrame, number: int) -> None:
        result = evaluate(trees.parsed(batch), ground_truth, encoder)
        for name in tables:
            result[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return each_batch(arriving(spark, root), checkpoint, work)
