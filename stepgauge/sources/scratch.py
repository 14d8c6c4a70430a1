"""Tables in the folder that all executors share, which cut a plan in two.

What several later plans read is written once; executors that are lost cost no
more than the tasks they ran.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where there is none and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stepgauge-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written and read back."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
