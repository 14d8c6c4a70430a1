"""Order constraints of proofs and how predictions keep them.

Two atoms are ordered if the container in which their ways part is a list.  So
each atom is listed under all containers above it, and within a list the atoms
below an earlier child come before those below a later one: an equi-join on the
container, without looking for common ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.functions.measures import ratio, rounded
from stepgauge.operators.align import best


def constraints(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, constraint_index, before_gt_atom_index, after_gt_atom_index of atoms(keys, atom_index, steps).

    Constraints are numbered container by container, inner ones first.
    """
    depth = F.posexplode("steps").alias("depth", "step")
    below = atoms.select(*keys, "atom_index", "steps", depth)
    below = below.select(*keys, "atom_index", F.slice("steps", F.lit(1), F.col("depth")).alias("above"), "depth", F.col("step.kind").alias("kind"), F.col("step.child").alias("child"))
    box = [*keys, "above"]
    below = below.withColumn("end", F.max("atom_index").over(Window.partitionBy(*box))).where("kind = 'list'")
    first = below.select(*box, "depth", "end", F.col("child").alias("child_a"), F.col("atom_index").alias("before_gt_atom_index"))
    second = below.select(*box, F.col("child").alias("child_b"), F.col("atom_index").alias("after_gt_atom_index"))
    pairs = first.join(second, box).where("child_a < child_b")
    w = Window.partitionBy(*keys).orderBy("end", F.desc("depth"), "child_a", "child_b", "before_gt_atom_index", "after_gt_atom_index")
    return pairs.withColumn("constraint_index", F.row_number().over(w)).select(*keys, "constraint_index", "before_gt_atom_index", "after_gt_atom_index")


def placed(combined: DataFrame, keys: list[str], threshold) -> DataFrame:
    """Where each reference atom stands in the prediction: its best pair, if that reaches the threshold."""
    limit = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    top = best(combined, keys, score="combined")
    return top.select(*keys, "gt_atom_index", F.when(F.col("combined") >= limit, F.col("model_atom_index")).alias("place"), rounded(F.col("combined")).alias("match_score"))


def status(rules: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """rules with both places and scores, and whether they are respected, violated or unmatched; the same place respects."""
    out = rules
    for side in ("before", "after"):
        own = places.select(*keys, F.col("gt_atom_index").alias(f"{side}_gt_atom_index"), F.col("place").alias(f"{side}_model_atom_index"), F.col("match_score").alias(f"{side}_match_score"))
        out = out.join(own, [*keys, f"{side}_gt_atom_index"], "left")
    before, after = F.col("before_model_atom_index"), F.col("after_model_atom_index")
    out = out.withColumn("status", F.when(before.isNull() | after.isNull(), "unmatched").when(before <= after, "respected").otherwise("violated"))
    return out.withColumn("respected", F.col("status") == "respected")


def summary(judged: DataFrame, keys: list[str], everything: DataFrame | None = None) -> DataFrame:
    """Counts of constraints by status and the three order scores; all 1 without constraints.

    everything: the keys of all cases; those without constraints get their row.
    """
    count = lambda s: F.count_if(F.col("status") == s)
    out = judged.groupBy(*keys).agg(F.count("status").alias("total_constraints"), count("respected").alias("respected_constraints"), count("violated").alias("violated_constraints"), count("unmatched").alias("unmatched_constraints"))
    if everything is not None:
        out = everything.select(*keys).distinct().join(out, keys, "left").na.fill(0)
    n, good, bad = (F.col(f"{x}_constraints") for x in ("total", "respected", "violated"))
    score = lambda c: F.when(n == 0, 1.0).otherwise(rounded(c))
    return out.withColumns({"order_score": score(ratio(good, good + bad)), "order_coverage": score(ratio(good + bad, n)), "strict_order_score": score(ratio(good, n))})
