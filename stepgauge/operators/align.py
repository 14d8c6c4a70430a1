"""Alignment of reference atoms with predicted ones.

Pairs are only made within a case and subquestion, a block of chunks at a time
(``blocks``).  All pairs are made only for who wants the matrix; best matches and
summaries take what they need from the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.operators import blocks
from stepgauge.sources.scratch import kept


def _limit(threshold: Column | float) -> Column:
    return threshold if isinstance(threshold, Column) else F.lit(float(threshold))


def _shared(rows: DataFrame, matched: Column) -> DataFrame:
    return rows.withColumn("matched", matched).withColumn("embedding_score", F.col("score")).drop("cosine")


def matrix(reference: DataFrame, predicted: DataFrame, keys: list[str], threshold: Column | float, band: tuple[float, float] | None = None) -> DataFrame:
    """Each reference atom with each predicted one of the same keys: embedding_score, score, matched.

    reference has gt_atom_index and gt_vectors, predicted model_atom_index and
    model_vectors, besides what shall stay.  A reference atom without predicted
    ones has no row.  Both sides are read twice, once for the sizes of the keys.
    band: only the pairs whose score lies in it.
    """
    return _shared(blocks.pairs(reference, predicted, keys, band), F.col("cosine") >= _limit(threshold))


def targets_matrix(targets: DataFrame, predicted: DataFrame, keys: list[str], threshold: Column | float) -> DataFrame:
    """Like ``matrix`` for required statements; one without predicted atoms keeps a row with score 0."""
    there = blocks.pairs(targets, predicted, keys)
    alone = targets.drop("gt_vectors").join(predicted.select(*keys).distinct(), keys, "left_anti")
    none = [F.lit(None).cast(predicted.schema[c].dataType).alias(c) for c in predicted.columns if c not in (*keys, "model_vectors")]
    pairs = there.unionByName(alone.select("*", *none, F.lit(0.0).alias("cosine"), F.lit(0.0).alias("score")))
    named = F.col("model_atom_index").isNotNull()
    pairs = pairs.withColumns({c: F.when(named, F.col(c)).otherwise(0.0) for c in ("cosine", "score")})
    return _shared(pairs, named & (F.col("cosine") >= _limit(threshold)))


def matched_items(reference: DataFrame, predicted: DataFrame, keys: list[str], threshold: Column | float, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What a matrix's summary needs, without the matrix: (each reference atom's best row, as ``best`` finds it; each predicted atom's ``hit``).

    by: columns of the reference by which hits are told apart; the threshold is a number or a column over keys.
    """
    rows = kept(blocks.best(reference, predicted, keys, by), "best")
    found = best(rows.where("not offered").drop("offered"), [*keys, *(by or [])]).withColumn("matched", F.col("cosine") >= _limit(threshold)).drop("cosine")
    offered = rows.where("offered and model_atom_index is not null").groupBy(*keys, *(by or []), "model_atom_index").agg(F.max("cosine").alias("cosine"))
    return found, offered.select(*keys, *(by or []), "model_atom_index", (F.col("cosine") >= _limit(threshold)).alias("hit"))


def best(rows: DataFrame, keys: list[str], item: str = "gt_atom_index", candidate: str = "model_atom_index", score: str = "score") -> DataFrame:
    """The row with the highest score of each item; of equal ones that with the lowest candidate."""
    # a largest struct combines before the shuffle; a rank would move and sort all rows
    place = F.struct(F.col(score).alias("__score"), F.col(candidate).isNotNull().alias("__named"), (-F.col(candidate)).alias("__last"))
    rest = [c for c in rows.columns if c not in (*keys, item)]
    found = rows.groupBy(*keys, item).agg(F.max_by(F.struct(*rest), place).alias("__row"))
    return found.select(*keys, item, "__row.*").select(*rows.columns)


def named_best(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "gt_atom_index", F.col("model_atom_index").alias("best_model_atom_index"), F.col("score").alias("best_score"), "matched")


def best_matches(rows: DataFrame, keys: list[str], everything: DataFrame | None = None) -> DataFrame:
    """keys, gt_atom_index, best_model_atom_index, best_score, matched.

    everything: (keys, gt_atom_index) of all reference items; those without rows get a score of 0.
    """
    found = named_best(best(rows, keys), keys)
    if everything is None:
        return found
    out = everything.select(*keys, "gt_atom_index").join(found, [*keys, "gt_atom_index"], "left")
    return out.withColumns({"best_score": F.coalesce("best_score", F.lit(0.0)), "matched": F.coalesce("matched", F.lit(False))})


# Where a required statement comes from, in order of precedence.
SOURCES = ["global_assumption", "local_assumption", "previous_outcome", "gt_precondition"]


def first_seen(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in an order."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return found.select(*keys, "__row.*").select(*rows.columns)


def required(parts: dict[str, DataFrame], keys: list[str], text: str = "text", place: str = "place") -> DataFrame:
    """The union of required statements of several sources (in SOURCES' order), each text once, and its number.

    parts: by source, rows with keys, a text and a place that orders them.
    """
    union = None
    for n, (source, rows) in enumerate(sorted(parts.items(), key=lambda kv: SOURCES.index(kv[0]))):
        part = rows.select(*keys, F.lit(n).alias("priority"), F.lit(source).alias("gt_source"), F.col(place).alias("place"), F.col(text).alias("text"))
        union = part if union is None else union.unionByName(part)
    union = union.where("text != ''")
    once = first_seen(union, [*keys, "text"], [F.col("priority"), F.col("place")])
    w = Window.partitionBy(*keys).orderBy("priority", "place")
    return once.withColumn("gt_atom_index", F.row_number().over(w)).drop("priority")


def earlier(rows: DataFrame, keys: list[str], at: str, values: str, upto: DataFrame) -> DataFrame:
    """What the steps before each step say: upto(keys, at) with the values of all smaller ``at``, where first said.

    A statement that is first made at step j is wanted by every later step; so
    the distinct statements are joined to the steps, and not all mentions.
    """
    said = rows.select(*keys, F.col(at).alias("said_at"), F.posexplode(values).alias("said_pos", "text"))
    said = said.groupBy(*keys, "text").agg(F.min(F.struct("said_at", "said_pos")).alias("first"))
    said = said.select(*keys, "text", "first.said_at", "first.said_pos")
    return upto.select(*keys, at).distinct().join(said, keys).where(F.col("said_at") < F.col(at))
