"""Mixing sources to target weights by hierarchical budgeting (DataFrame operations only).

A tree of domain, language and source has a weight at every node.  Budgets go
down from the root: the children of a node share its budget by weight, a child
that has fewer tokens (times ``max_epochs``) than its share takes what it has,
and what it lacks goes to its siblings by weight; as a node is never given more
than its leaves hold, only what all siblings lack reaches the ancestors.  Each
leaf then takes whole epochs and of one further epoch, in a seeded order, the
prefix of documents that begins within the rest of its budget.

The tree is a table; nothing of it is collected.  A leaf's prefix is found with
token sums of ranges of the seeded hash, and rows are ranked only in the one
range where the leaf's budget ends, so a hot leaf is never in one task.

Cases: null domain, lang or source are nodes of their own (''); null or empty
texts have 0 tokens and come with the epochs that are whole; repeated rows are
ordered and taken alike but each counts; no documents or no budget give no
rows; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.llm.store import Scratch

LEVELS = ("domain", "lang", "source")
SEED, RANGE_ROWS = 23, 4096
#: More leaves than this are joined by a shuffle and not sent to all executors.
LEAVES_SENT = 10_000


def n_tokens(text: str = "text") -> Column:
    """Tokens of a text: runs without ASCII white space."""
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"\S+"))).cast("long")


def default_domain() -> Column:
    """A source's domain where the corpus has none: one of four by its name."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(4)).cast("string"))


def water_fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes(parent.., weight, capacity, given) with ``budget``: given shared by weight, no child above its capacity.

    In order of capacity per weight a child is full as long as that is at most
    what is left per weight that is left; all others get that level times weight.
    """
    w = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "name")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.greatest(F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0))
    level = left / F.sum("weight").over(after)
    full = F.col("capacity") <= level * F.col("weight")
    out = nodes.withColumn("__level", level).withColumn("__full", full)
    first = F.max(F.when(~F.col("__full"), F.col("__level"))).over(Window.partitionBy(*parent))
    return out.withColumn("budget", F.when(F.col("__full"), F.col("capacity").cast("double")).otherwise(F.least(first * F.col("weight"), F.col("capacity")))).drop("__level", "__full")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, Column] | None = None, max_epochs: int = 1) -> DataFrame:
    """leaves(domain, lang, source, tokens, rows) with ``budget`` in whole tokens.

    weights gives per level a column over that level's names (default 1); a
    weight below 1e-9 counts as that, so a node is starved and never divides by 0.
    """
    at = leaves.withColumn("capacity", F.col("tokens") * max_epochs).withColumn("root", F.lit(0))
    given = at.groupBy("root").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).select("root", F.least("capacity", total).alias("given"))
    parents = ["root"]
    for level in LEVELS:
        keys = [*parents, level]
        nodes = at.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).join(given, parents)
        weight = F.greatest((weights or {}).get(level, F.lit(1.0)).cast("double"), F.lit(1e-9))
        nodes = nodes.withColumns({"weight": weight, "name": F.col(level)})
        given = water_fill(nodes, parents).select(*keys, F.col("budget").alias("given"))
        parents = keys
    return leaves.join(given.drop("root"), list(LEVELS)).withColumn("budget", F.least(F.round("given").cast("long"), F.col("tokens") * max_epochs)).drop("given")


def plan(scratch: Scratch, rows: DataFrame, share: float, weights: dict[str, Column] | None, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: budget, whole epochs, and how much of the next one: the seeded hash up to which rows are taken.

    rows: the leaf's names, tokens, id (long) and version of each document.
    """
    leaves = scratch.keep(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total = F.floor(F.col("tokens") * F.lit(share))
    leaves = budgets(leaves, total, weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    leaves = leaves.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    leaves = scratch.keep(leaves.withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS)))
    ended = joined(rows, leaves.where("rest > 0")).withColumn("h", order_of(F.col("epochs"), seed))
    ranked = ended.withColumn("range", F.floor(F.shiftrightunsigned("h", 32) * F.col("ranges") / F.lit(float(1 << 31))))
    sums = ranked.groupBy(*LEVELS, "range").agg(F.sum("tokens_").alias("range_tokens"), F.first("rest").alias("rest"))
    w = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("range_tokens").over(w), F.lit(0)))
    last = scratch.keep(sums.where("before < rest and before + range_tokens >= rest").select(*LEVELS, "range", "before"))
    near = joined(ranked, last, [*LEVELS, "range"])
    w = Window.partitionBy(*LEVELS).orderBy(F.col("h")).rowsBetween(Window.unboundedPreceding, -1)
    taken = near.withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens_").over(w), F.lit(0))).where("so_far < rest")
    upto = scratch.keep(taken.groupBy(*LEVELS).agg(F.max("h").alias("upto")))
    return scratch.keep(leaves.join(upto, list(LEVELS), "left").select(*LEVELS, "tokens", "budget", "epochs", "upto"))


def order_of(epoch: Column, seed: int) -> Column:
    """The seeded place of a row in an epoch: a hash without sign (compared as one by its 63 high bits)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("id"), F.col("version")), 1)


def joined(rows: DataFrame, leaves: DataFrame, on: list[str] | None = None) -> DataFrame:
    """rows with their leaf's columns; leaves are sent to all executors if their count is small, else hot ones are salted."""
    on = list(on or LEVELS)
    rows = rows.withColumnRenamed("tokens", "tokens_") if "tokens" in rows.columns and "tokens" in leaves.columns else rows
    if leaves.count() <= LEAVES_SENT:
        return rows.join(F.broadcast(leaves), on)
    salts = 32
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("id", "version"), F.lit(salts)).cast("int"))
    leaves = leaves.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(leaves, [*on, "__salt"]).drop("__salt")


def leaf_columns(domain: Column | None) -> dict[str, Column]:
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return {"domain": name(domain if domain is not None else default_domain()), "lang": name(F.col("lang")), "source": name(F.col("source"))}


def mixed(docs: DataFrame, share: float, domain: Column | None = None, weights: dict[str, Column] | None = None, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """row (all columns of docs as a struct), domain, lang, source, tokens, epoch: one row for each time a document is taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    names = docs.columns
    key = {"id": F.xxhash64("doc_id"), "version": F.xxhash64("doc_id", "text")}
    rows = scratch.keep(docs.select(*[c.alias(n) for n, c in (leaf_columns(domain) | key).items()], n_tokens().alias("tokens")))
    leaves = plan(scratch, rows, share, weights, max_epochs, seed)
    scratch.drop(leaves)
    full = docs.select(*[c.alias(n) for n, c in (leaf_columns(domain) | key).items()], n_tokens().alias("tokens_"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    at = joined(full, leaves.drop("tokens"))
    epochs = [F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.expr("cast(array() as array<int>)"))]
    epochs.append(F.when(order_of(F.col("epochs"), seed) <= F.col("upto"), F.array(F.col("epochs"))).otherwise(F.expr("cast(array() as array<int>)")))
    return at.withColumn("epoch", F.explode(F.concat(*epochs))).select("row", *LEVELS, F.col("tokens_").alias("tokens"), "epoch", "budget")


def named_weights(level: str, given: dict[str, float], default: float = 1.0) -> Column:
    """A weight column from a dictionary of names."""
    return reduce(lambda c, kv: F.when(F.col(level) == kv[0], F.lit(kv[1])).otherwise(c), given.items(), F.lit(default))
