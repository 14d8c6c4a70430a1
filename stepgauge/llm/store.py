"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stepgauge-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage and survive lost executors.

    ``keep`` writes a table and reads it back; ``discard`` deletes tables,
    ``drop`` all but those that later plans read.  Tables that a result reads stay
    in the shared folder, as Spark's own checkpoints do.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, frames: tuple[DataFrame, ...]) -> list[str]:
        """The tables that these frames read."""
        bare = lambda path: path.split("://")[-1].split(":")[-1].lstrip("/")
        used = {bare(f.rsplit("/", 1)[0]) for df in frames for f in df.inputFiles()}
        return [path for path in self.paths if bare(path) in used]

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            self.paths.remove(path)

    def discard(self, *frames: DataFrame) -> None:
        """Delete the tables that these frames read."""
        self._delete(self._read(frames))

    def drop(self, *keep: DataFrame) -> None:
        """Delete all tables but those that ``keep`` still reads."""
        used = self._read(keep)
        self._delete([path for path in self.paths if path not in used])


class Sent:
    """An object for all executors; its class travels with it, so they need no copy of the package."""

    def __init__(self, spark: SparkSession, what: object):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(what))

    @property
    def value(self) -> object:
        return cloudpickle.loads(self.bytes.value)

    def close(self) -> None:
        """Take it from driver and executors."""
        self.bytes.destroy()
