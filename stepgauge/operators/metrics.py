"""Scores of dimensions, cases and groups; threshold calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.functions.measures import f1, midpoint, ratio, rounded
from stepgauge.operators.align import best

METRICS = ["mean_best_score", "coverage", "precision", "f1"]
# A report's columns of required statements, in order.
SOURCE_METRICS = ["mean_best_score", "recall", "precision", "f1"]
SOURCE_COLUMNS = ["global_assumption", "local_assumption", "gt_precondition", "previous_outcome"]


def dimension_summary(rows: DataFrame, keys: list[str], subkeys: list[str] | None = None) -> DataFrame:
    """keys, mean_best_score, coverage (recall), precision, f1, and the four counts behind them.

    rows is a matrix; items are told apart by subkeys (within keys) and their
    index.  Recall looks at the best row of each reference item, precision at
    any matched row of a predicted one.
    """
    inner = [*keys, *(subkeys or [])]
    offered = rows.where("model_atom_index is not null").groupBy(*inner, "model_atom_index").agg(F.bool_or("matched").alias("hit"))
    return items_summary(best(rows, inner), offered, keys)


def items_summary(found: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """``dimension_summary`` of each reference item's best row and each predicted item's ``hit`` (see ``align.matched_items``)."""
    wanted = found.groupBy(*keys).agg(
        F.avg("score").alias("mean"), F.count(F.lit(1)).alias("gt_items"), F.count_if("matched").alias("matched_gt_items"),
    )
    offered = offered.groupBy(*keys).agg(F.count(F.lit(1)).alias("model_items"), F.count_if("hit").alias("matched_model_items"))
    both = wanted.join(offered, keys, "left").na.fill(0, ["model_items", "matched_model_items"])
    recall, precision = ratio(F.col("matched_gt_items"), F.col("gt_items")), ratio(F.col("matched_model_items"), F.col("model_items"))
    return both.select(
        *keys, rounded(F.col("mean")).alias("mean_best_score"), rounded(recall).alias("coverage"), rounded(precision).alias("precision"), rounded(f1(precision, recall)).alias("f1"),
        "gt_items", "matched_gt_items", "model_items", "matched_model_items",
    )


def source_summary(rows: DataFrame, keys: list[str], subkeys: list[str] | None = None) -> DataFrame:
    """``dimension_summary`` of required statements by where they come from."""
    return dimension_summary(rows, [*keys, "gt_source"], subkeys)


def combined_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gt_atom_index, model_atom_index, combined: the mean of the dimensions that a pair has."""
    return rows.where("model_atom_index is not null").groupBy(*keys, "gt_atom_index", "model_atom_index").agg(F.avg("score").alias("combined"))


def combined_score(*scores: Column) -> Column:
    """``combined_scores`` of a row that has a pair's scores side by side: the mean of those that aren't null."""
    total, n = F.lit(0.0), F.lit(0)
    for score in scores:
        total, n = total + F.coalesce(score, F.lit(0.0)), n + F.when(score.isNull(), 0).otherwise(1)
    return F.when(n > 0, total / n)


def overall(d1: Column, d3: Column, d4: Column, strict_order: Column) -> dict[str, Column]:
    """A case's overall scores, without and with the order of steps."""
    return {"overall_mean_score": rounded((d1 + d3 + d4) / 3), "overall_with_D2_score": rounded((d1 + d3 + d4 + strict_order) / 4)}


# The averaged columns of a report.
REPORT_METRICS = [*(f"{d}_{m}" for d in ("D1", "D3", "D4") for m in METRICS), "D2_order_score", "D2_order_coverage", "D2_strict_order_score", "overall_mean_score", "overall_with_D2_score"]


def report(cases: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """keys, cases and the mean of each metric over the cases that went well."""
    good = cases.where("status = 'ok'")
    return good.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), *[rounded(F.avg(m)).alias(m) for m in metrics or REPORT_METRICS])


def reports(cases: DataFrame, group: list[str], model: str = "call1_model", strategy: str = "strategy", metrics: list[str] | None = None) -> DataFrame:
    """Both levels of report at once: by model (``strategy_level`` 1) and by model and strategy (0)."""
    good = cases.where("status = 'ok'")
    inner = [F.col(c) for c in (*group, model)]
    sets = good.groupingSets([inner, [*inner, F.col(strategy)]], *inner, F.col(strategy))
    return sets.agg(F.grouping(strategy).cast("int").alias("strategy_level"), F.count(F.lit(1)).alias("cases"), *[rounded(F.avg(m)).alias(m) for m in metrics or REPORT_METRICS])


def source_columns(sources: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """Means of the sources' metrics as columns D4_{source}_{metric}; over the cases in which a source occurs."""
    means = [rounded(F.avg(F.when(F.col("gt_source") == s, F.col(m)))).alias(f"D4_{s}_{n}") for s in names or SOURCE_COLUMNS for m, n in zip(METRICS, SOURCE_METRICS, strict=True)]
    return sources.groupBy(*keys).agg(*means)


def coverage_columns(cases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected_cases, found_cases, missing_cases, generation_coverage of rows with a status."""
    found = F.count_if(F.col("status") == "found")
    n = F.count(F.lit(1))
    return cases.groupBy(*keys).agg(n.alias("expected_cases"), found.alias("found_cases"), (n - found).alias("missing_cases"), rounded(found / n).alias("generation_coverage"))


def end_to_end(rows: DataFrame, names: list[str]) -> DataFrame:
    """A report's scores times the share of cases that were found; null where none was expected."""
    share = F.col("found_cases") / F.nullif("expected_cases", F.lit(0))
    return rows.withColumns({f"end_to_end_{n}": rounded(F.col(n) * share) for n in names})


# -- calibration: rows with a cosine and whether they should match

def threshold_metrics(at: Column) -> dict[str, Column]:
    """Aggregates: how a threshold tells matching pairs from others; an empty class has recall 0."""
    cosine, expected = F.col("cosine"), F.col("expected_match")
    hit, miss = F.count_if((cosine >= at) & expected), F.count_if((cosine < at) & ~expected)
    positives, negatives, n = F.count_if(expected), F.count_if(~expected), F.count(F.lit(1))
    recall, rejected = ratio(hit, positives), ratio(miss, negatives)
    return {"accuracy": ratio(hit + miss, n), "balanced_accuracy": (recall + rejected) / 2, "equivalent_recall": recall, "unrelated_recall": rejected}


def sweep(pairs: DataFrame, step: float = 0.01, keys: list[str] | None = None) -> DataFrame:
    """threshold and its metrics, for thresholds from 0 to 1.

    The pairs are not repeated for each threshold: a pair says yes at every
    threshold up to its cosine, so counts by the last such threshold, added up
    from above, are all that a threshold needs.
    """
    if not 0 < step <= 1:
        raise ValueError("the step of thresholds must be above 0 and at most 1")
    keys, last = keys or [], int(1 / step + 1e-9)
    grid = pairs.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("slot"), rounded(F.col("id") * F.lit(step)).alias("threshold"))
    near = F.floor(F.col("cosine") / F.lit(step)).cast("int")
    at = lambda k: rounded(k * F.lit(step))
    # division may fall on either side of a grid point; the comparison with the point itself decides
    slot = F.when(F.col("cosine") >= at(near + 1), near + 1).when(F.col("cosine") < at(near), near - 1).otherwise(near)
    counted = pairs.select(*keys, F.least(F.greatest(slot, F.lit(-1)), F.lit(last)).alias("slot"), F.col("expected_match").alias("good"))
    counted = counted.groupBy(*keys, "slot").agg(F.count_if("good").alias("yes"), F.count_if(~F.col("good")).alias("no"))
    every = grid.crossJoin(counted.select(*keys).distinct()) if keys else grid
    low = counted.where("slot < 0").select(*keys, "slot", F.lit(None).cast("double").alias("threshold"))
    whole = every.select(*keys, "slot", "threshold").unionByName(low).join(counted, [*keys, "slot"], "left").na.fill(0, ["yes", "no"])
    up = Window.partitionBy(*keys).orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    whole = whole.withColumns({"hit": F.sum("yes").over(up), "wrong": F.sum("no").over(up), "positives": F.sum("yes").over(total), "negatives": F.sum("no").over(total)}).where("slot >= 0")
    hit, miss = F.col("hit"), F.col("negatives") - F.col("wrong")
    recall, rejected = ratio(hit, F.col("positives")), ratio(miss, F.col("negatives"))
    return whole.select(
        *keys, "threshold", rounded(ratio(hit + miss, F.col("positives") + F.col("negatives"))).alias("accuracy"), rounded((recall + rejected) / 2).alias("balanced_accuracy"),
        rounded(recall).alias("equivalent_recall"), rounded(rejected).alias("unrelated_recall"), ((recall + rejected) / 2).alias("exact"),
    )


def recommended(swept: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The middle of all thresholds with the best balanced accuracy."""
    keys = keys or []
    top = swept.withColumn("top", F.max("exact").over(Window.partitionBy(*keys))).where("exact = top")
    return top.groupBy(*keys).agg(midpoint(F.min("threshold"), F.max("threshold")).alias("recommended_threshold"), F.max("balanced_accuracy").alias("balanced_accuracy"))


def label_summary(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, median, least, most and accuracy of each label; and of all, of which only count and accuracy are given."""
    keys = keys or []
    own = lambda c: F.when(F.grouping("label") == 0, c)
    sets = scored.groupingSets([[*map(F.col, keys), F.col("label")], [*map(F.col, keys)]], *keys, "label")
    return sets.agg(
        F.grouping("label").alias("__all"), F.count(F.lit(1)).alias("count"),
        *[own(rounded(f("cosine"))).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))],
        rounded(F.count_if("correct_at_threshold") / F.count(F.lit(1))).alias("accuracy_at_threshold"),
    ).withColumn("label", F.when(F.col("__all") == 1, "overall").otherwise(F.col("label"))).drop("__all")
