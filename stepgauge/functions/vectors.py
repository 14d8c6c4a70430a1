"""Vectors: inner products, and encoding each distinct text once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gives the unit vectors of some texts, one row each.
Encoder = Callable[[list[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, added up in order as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def coverage(wanted: Column, offered: Column) -> Column:
    """How well one set of vectors is covered by another: the mean over the first of the best cosine.

    1 if nothing is wanted, 0 if nothing is offered.
    """
    best = F.transform(wanted, lambda w: F.array_max(F.transform(offered, lambda o: dot(w, o))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(wanted)
    return F.when(F.size(wanted) == 0, 1.0).when(F.size(offered) == 0, 0.0).otherwise(mean)


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a sentence encoder: hashed words and letter triples, as unit vectors."""
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            words = text.lower().split()
            grams = words + [w[k : k + 3] for w in (f" {w} " for w in words) for k in range(len(w) - 2)]
            for gram in grams or [""]:
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
            out[i] /= np.linalg.norm(out[i]) or 1
        return out

    return encode


def encoded(texts: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """text, vector of the distinct texts: the encoder sees each once, a batch at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "vector": [row.tolist() for row in np.asarray(encoder(list(batch["text"])), np.float32)]})

    once = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    return once.mapInPandas(run, "text string, vector array<float>")


def texts_of(rows: DataFrame, *arrays: str) -> DataFrame:
    """text: all texts of some array columns."""
    out = None
    for array in arrays:
        part = rows.select(F.explode(array).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def with_vectors(rows: DataFrame, keys: list[str], columns: dict[str, str], encoder: Encoder | None, vectors: DataFrame | None = None) -> DataFrame:
    """rows with a column of vectors for each array of texts: columns maps the new names to the arrays.

    keys tell the rows apart.  The texts are joined to the encoded ones (to
    ``vectors``, text and vector of each, if they are encoded already) by a
    shuffle on the text and come back together by the keys; arrays keep their order.
    """
    parts = [rows.select(*keys, F.lit(new).alias("__into"), F.posexplode(array).alias("__at", "text")) for new, array in columns.items()]
    long = parts[0]
    for part in parts[1:]:
        long = long.union(part)
    in_order = lambda new: F.transform(F.array_sort(F.collect_list(F.when(F.col("__into") == new, F.struct("__at", "vector")))), lambda x: x["vector"])
    held = long.join(vectors if vectors is not None else encoded(long, encoder), "text").groupBy(*keys).agg(*[in_order(new).alias(new) for new in columns])
    held = held.select(*[F.col(k).alias(f"__{k}") for k in keys], *columns)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    none = F.expr("cast(array() as array<array<float>>)")
    return rows.join(held, same, "left").select(*[F.col(c) for c in rows.columns], *[F.coalesce(new, none).alias(new) for new in columns])
