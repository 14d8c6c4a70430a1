"""Uniform sharding by a hypergeometric communication matrix (DataFrame operations only).

The rows of each partition of the input are permuted by a seeded hash where they
lie, without an exchange, and written with their partition and place.  For each
partition the exact number of rows that it sends to every shard is drawn from the
multivariate hypergeometric law, so that shards are equally likely to hold any
set of rows and their sizes are exact (at most one row apart).  A partition's
rows are dealt out by its row of the matrix, exchanged once, and permuted again
within their shard; the second permutation is ranked in ranges of its hash, of
about ``RANGE_ROWS`` rows each, whose row counts give each range its first slot.

A row is known by its partition and place, so rows that are equal as a whole are
dealt independently of each other.  Partition and range counts alone reach the
driver or all executors; more partitions than ``PARTITIONS_SENT`` are joined and
not sent.  Draws are worked out in doubles: for shards of 1e12 rows or more their
probabilities are good to three digits.

Cases: an empty table gives no rows; null and empty texts are rows like any
other; repeated rows too; with fewer rows than shards some shards are empty;
other columns pass through untouched whatever their names.  The same table in
the same partitions is dealt alike again.
"""

from __future__ import annotations

import random
from math import exp, lgamma

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.llm.store import Scratch

SHARDS, SEED = 8, 29
#: Rows of a range of the second permutation; partitions whose rows of the matrix are sent to all executors.
RANGE_ROWS, PARTITIONS_SENT = 8192, 100_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good: exact, by inversion from the mode outwards."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    p = exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Rows of each block for each shard: row sums are the sizes, column sums are at most one apart."""
    rng, total = random.Random(seed), sum(sizes)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for size in sizes:
        left, free, row = size, sum(room), []
        for j in range(shards):
            got = hypergeometric(rng, room[j], free - room[j], left)
            free -= room[j]
            room[j] -= got
            left -= got
            row.append(got)
        out.append(row)
    return out


def _draw(seed: int, *key: Column) -> Column:
    """63 seeded bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 1)


def _part(h: Column, n: int) -> Column:
    """Which of n equal ranges a draw lies in."""
    return F.floor(F.shiftright(h, 31) * n / F.lit(float(1 << 32))).cast("int")


def permuted(docs: DataFrame, seed: int) -> DataFrame:
    """row (all columns of docs as a struct), part, place: each partition's rows in a seeded order.

    An id that counts up holds the partition (from bit 33) and the place in it.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _draw(seed, F.monotonically_increasing_id()).alias("draw"))
    rows = rows.sortWithinPartitions("draw").select("row", F.monotonically_increasing_id().alias("at"))
    return rows.select("row", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))


def dealt(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """row (all columns of docs as a struct), shard, slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    local = scratch.keep(permuted(docs, seed))
    sizes = sorted((r[0], r[1]) for r in local.groupBy("part").count().collect())  # one row for each partition
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    upto = [(part, [sum(row[: j + 1]) for j in range(shards)]) for (part, _), row in zip(sizes, matrix, strict=True)]
    bounds = spark.createDataFrame(upto, "part int, upto array<long>")
    sent = local.join(F.broadcast(bounds) if len(sizes) <= PARTITIONS_SENT else bounds, "part")
    sent = sent.withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("place"))).cast("int")).withColumn("draw", _draw(seed + 1, F.col("part"), F.col("place")))
    sent = sent.withColumn("range", _part(F.col("draw"), max(1, -(-sum(n for _, n in sizes) // (shards * RANGE_ROWS)))))
    ranges = scratch.keep(sent.groupBy("shard", "range").count())
    ranges = ranges.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    slot = F.row_number().over(Window.partitionBy("shard", "range").orderBy("draw", "part", "place")) - 1
    # both sides lie by shard and range, so whole rows are exchanged once however large the ranges' table is
    return sent.withColumn("inner", slot).join(ranges, ["shard", "range"]).select("row", "shard", (F.col("before") + F.col("inner")).cast("long").alias("slot"))
