"""Distinct statements, balanced samples of them, stable ids, pair templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.functions.ranking import numbered
from stepgauge.operators.align import first_seen
from stepgauge.sources.scratch import kept

# Statement fields and pair labels, in order.
FIELDS = ["assumption_global", "assumptions", "preconditions", "arguments", "outcomes"]
LABELS = ["equivalent", "related_but_not_equivalent", "unrelated"]
VARIANTS = 2


def distinct_statements(rows: DataFrame, key: list[Column], order: str) -> DataFrame:
    """Of rows with equal keys the first; blank texts go."""
    rows = rows.where(F.col("text").rlike(r"\S")).withColumn("__key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
    return first_seen(rows, ["__key"], [F.col(order)])


def round_robin(rows: DataFrame, field: str, order: str, count: int, fields: list[str] | None = None) -> DataFrame:
    """``count`` rows (a sampling operator: that is its feature), taking each field's next in turn, and their ``pick``.

    Only the first ``count`` rows of each field can be picked, so no more than
    that of a field is ranked across fields.
    """
    own = Window.partitionBy(field).orderBy(order)
    turn = rows.withColumn("__turn", F.row_number().over(own)).where(F.col("__turn") <= count)
    place = F.array_position(F.array(*map(F.lit, fields)), F.col(field)) if fields else F.col(field)
    if fields:
        turn = turn.where(F.col(field).isin(*fields))
    top = turn.withColumn("__place", place).orderBy("__turn", "__place").limit(count)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("__turn", "__place"))).drop("__turn", "__place")


def balanced(rows: DataFrame, key: list[Column], order: str, count: int, retained: DataFrame | None = None) -> DataFrame:
    """A balanced sample: retained statements (with ``__key`` and ``at``) that are still there first, then field by field; an error if short."""
    rows = distinct_statements(rows, key, order)
    if retained is not None:
        first = retained.groupBy("__key").agg(F.min("at").alias("at"))
        old = rows.join(first, "__key").orderBy("at").limit(count)
        old = kept(old.withColumn("pick", F.row_number().over(Window.orderBy("at"))).drop("at"), "retained")
        n = old.count()
        more = round_robin(rows.join(old.select("__key"), "__key", "left_anti"), "field", order, count - n, FIELDS) if n < count else None
        out = old if more is None else old.unionByName(more.withColumn("pick", F.col("pick") + n))
    else:
        out = round_robin(rows, "field", order, count, FIELDS)
    out = kept(out, "sample")  # ``count`` rows at most, which are counted and used
    have = out.count()
    if have < count:
        raise ValueError(f"{count} distinct statements are wanted, but there are {have}")
    return out


def stable_ids(rows: DataFrame, order: str, used: DataFrame, prefix: str = "sem_", digits: int = 4, given: str = "id") -> DataFrame:
    """rows with an id: the one they have, else the next number that is not in use.

    The numbers that can be needed are those up to all ids there will be; those
    in use go by an anti-join, and the n-th that is left belongs to the n-th row.
    """
    pattern = rf"^{prefix}(\d+)$"
    taken = used.where(F.col("id").rlike(pattern)).select(F.regexp_extract("id", pattern, 1).cast("long").alias("id")).distinct()
    fresh = rows.where(F.col(given).isNull())
    n, m = fresh.count(), taken.count()
    free = numbered(rows.sparkSession.range(1, n + m + 1).join(taken, "id", "left_anti"), "id", "nth").select("nth", F.col("id").alias("__number"))
    named = numbered(fresh, order, "nth").join(free, "nth").withColumn(given, F.format_string(f"{prefix}%0{digits}d", F.col("__number")))
    return rows.where(F.col(given).isNotNull()).unionByName(named.select(*rows.columns))


def templates(statements: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Three pair templates for each statement(id, key, concept, text): its variants of before, else to be written."""
    label = F.explode(F.array(*map(F.lit, LABELS))).alias("label")
    rows = statements.select("*", label)
    todo = F.array(*[F.lit("TODO")] * VARIANTS)
    if previous is not None:
        old = previous.select(F.col("__key").alias("__old"), F.col("label").alias("__label"), "text_b_variants")
        rows = rows.join(old, (F.col("__key") == F.col("__old")) & (F.col("label") == F.col("__label")), "left")
        variants = F.when(F.size("text_b_variants") > 0, F.col("text_b_variants")).otherwise(todo)
    else:
        variants = todo
    return rows.select(F.concat_ws("_", "id", "label").alias("id"), F.lit("semantic").alias("type"), "label", "concept", F.col("id").alias("source_statement_id"), F.col("text").alias("text_a"), variants.alias("text_b_variants"))


def variants(pairs: DataFrame) -> DataFrame:
    """Each variant of each pair template, numbered from 1."""
    return pairs.select(*[c for c in pairs.columns if c != "text_b_variants"], F.posexplode("text_b_variants").alias("__n", "text_b")).withColumn("variant_index", F.col("__n") + 1).drop("__n")
