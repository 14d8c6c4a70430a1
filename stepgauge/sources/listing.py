"""Trees of files, listed and read by the executors.

A listing is a table: neither the driver nor a plan holds a tree's files one by
one, and a task reads as many files as is good for it, small as they are.  Names
that begin with a dot or an underscore are no files, as for Spark's own readers.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgauge.sources.scratch import kept

#: Names that one task looks at before it leaves folders to others; paths or bytes that are handed over at once.
FIRST, PATHS, BYTES = 2000, 10_000, 8 << 20
#: Files of a task, at least where there are few and at most where there are many.
FEW, MANY = 256, 4096


def located(root: str) -> str:
    """A folder's address for executors: as given if it has a scheme, else the absolute path."""
    return root if re.match(r"\w+:/", root) else os.path.abspath(root)


def reachable(root: str) -> bool:
    """Whether Arrow reaches a folder's store; if not, Spark has to read it."""
    try:
        arrow_fs.FileSystem.from_uri(located(root))
    except (OSError, ValueError, NotImplementedError):
        return False
    return not re.search(r"[*?\[\]{}]", root)


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob over names."""
    out, depth = "", 0
    for c in glob:
        depth += {"{": 1, "}": -1}.get(c, 0)
        out += {"*": ".*", "?": ".", "{": "(?:", "}": ")"}.get(c, "|" if c == "," and depth else re.escape(c))
    return rf"(?s)\A{out}\Z"


def hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(store: arrow_fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what is in a folder."""
    if isinstance(store, arrow_fs.LocalFileSystem):  # without asking for each file's size and time
        with os.scandir(folder) as found:
            yield from ((x.name, x.is_dir()) for x in found)
    else:
        yield from ((x.base_name, x.type == arrow_fs.FileType.Directory) for x in store.get_file_info(arrow_fs.FileSelector(folder)))


def _walk(address: str, pattern: str | None, first: int | None):
    """Of folders below an address the files; folders that are left when ``first`` names were seen come as folders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(address)
        fits = re.compile(pattern).match if pattern else lambda name: True
        pack = lambda paths, folder: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([folder] * len(paths), pa.bool_())], ["path", "folder"])
        for batch in batches:
            queue, paths, seen = deque(batch.column("path").to_pylist()), [], 0
            while queue and (first is None or seen < first):
                here = queue.popleft()
                if here == "":
                    kind = store.get_file_info(base).type
                    if kind != arrow_fs.FileType.Directory:
                        yield pack(["" if kind != arrow_fs.FileType.NotFound else None], False)
                        continue
                for name, folder in _entries(store, f"{base}/{here}" if here else base):
                    seen += 1
                    path = f"{here}/{name}" if here else name
                    if hidden(name):
                        continue
                    if folder:
                        queue.append(path)
                    elif fits(name):
                        paths.append(path)
                        if len(paths) == PATHS:
                            yield pack(paths, False)
                            paths = []
            yield pack(paths, False)
            yield pack(list(queue), True)

    return run


def listed(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame | None:
    """path: the files below root whose name fits the glob, as they are now; None if there is no root."""
    walk = lambda rows, first: kept(rows.mapInArrow(_walk(located(root).rstrip("/"), glob and glob_pattern(glob), first), "path string, folder boolean"), "listed")
    found = walk(spark.range(1, numPartitions=1).select(F.lit("").alias("path")), FIRST)
    if not found.where("path is null").isEmpty():
        return None
    left = found.where("folder")
    n = left.count()
    if n:
        parts = min(n, 4 * spark.sparkContext.defaultParallelism)
        found = found.where("not folder").unionByName(walk(left.select("path").repartition(parts), None))
    return found.where("not folder").select("path")


def spread(paths: DataFrame, ordered: bool = False) -> DataFrame:
    """Paths, dealt out for reading; ``ordered``: by path."""
    n = paths.count()
    parts = max(1, min(n // FEW, max(4 * paths.sparkSession.sparkContext.defaultParallelism, n // MANY)))
    return paths.repartitionByRange(parts, "path").sortWithinPartitions("path") if ordered else paths.repartition(parts)


def contents(root: str):
    """A function of a column of paths below root: the files' bytes, a bounded number at once."""
    address = located(root).rstrip("/")

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store, base = arrow_fs.FileSystem.from_uri(address)
        local = isinstance(store, arrow_fs.LocalFileSystem)
        for paths in batches:
            out, size = [], 0
            for path in paths.to_pylist():
                place = f"{base}/{path}" if path else base
                with open(place, "rb") if local else store.open_input_stream(place, compression=None) as file:
                    out.append(file.read())
                size += len(out[-1])
                if size > BYTES:
                    yield pa.array(out, pa.binary())
                    out, size = [], 0
            yield pa.array(out, pa.binary())

    return F.arrow_udf(read, "binary")
