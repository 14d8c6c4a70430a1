"""Choice of one conversion for each answer, by its faithfulness to the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgauge.functions.measures import rounded
from stepgauge.functions.text import expected_blocks
from stepgauge.operators import selection
from stepgauge.schemas import RESPONSE
from stepgauge.sources import trees
from stepgauge.sources.config import RANKING_WEIGHTS, TIE_MARGIN

PARTS = list(RANKING_WEIGHTS)


def scored(responses: DataFrame, candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Each candidate with its response: valid, error, atom_count, the five measures and the score.

    responses: RESPONSE and text; candidates: RESPONSE, call2_model, path and
    text.  Invalid candidates have a score of 0.
    """
    answers = responses.select(*RESPONSE, F.col("text").alias("source"), expected_blocks(F.col("text")).alias("expected"))
    both = candidates.join(answers, RESPONSE)
    read = trees.parsed(both, "text", "expected", check=True)
    atoms = F.flatten(F.transform("subquestions", lambda s: s["atoms"]))
    valid = F.col("error").isNull()
    out = selection.components(read.withColumns({"atoms": atoms, "valid": valid}), "source", "atoms")
    out = out.withColumn("score", selection.weighted({p: F.col(p) for p in PARTS}, weights)).withColumn("atom_count", F.size("atoms"))
    zero = lambda c, kind: F.when(F.col("valid"), F.col(c)).otherwise(F.lit(0).cast(kind))
    return out.select(*RESPONSE, "call2_model", "path", "valid", F.coalesce("error", F.lit("")).alias("error"), zero("score", "double").alias("score"), zero("atom_count", "int").alias("atom_count"), *[zero(p, "double").alias(p) for p in PARTS])


def select(responses: DataFrame, candidates: DataFrame, weights: dict[str, float] | None = None, tie: float = TIE_MARGIN) -> dict[str, DataFrame]:
    """candidates (scored), selections (one row for each response) and summary."""
    every = scored(responses, candidates, weights)
    best = selection.winners(every.where("valid"), RESPONSE, tie=tie)
    best = best.select(*RESPONSE, F.col("call2_model").alias("selected_call2_model"), rounded(F.col("score")).alias("selection_score"), "selection_margin", "needs_review", F.col("path").alias("selected_path"))
    rows = responses.select(*RESPONSE).join(best, RESPONSE, "left")
    rows = rows.withColumn("status", F.when(F.col("selected_path").isNull(), "all_candidates_failed").otherwise("selected"))
    target = F.concat_ws("/", "call1_model", "language", "variation", F.concat("exercise", F.lit("_"), "strategy_abbreviation", F.lit(".yaml")))
    rows = rows.withColumn("target", target)
    return {"candidates": every, "selections": rows, "summary": selection.selection_summary(rows, F.col("status") == "selected")}


def chosen_texts(selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """target, text of the winners: what is copied to the folder of selected conversions."""
    own = candidates.select(F.col("path").alias("selected_path"), "text")
    return selections.where("status = 'selected'").join(own, "selected_path").select("target", "text")
