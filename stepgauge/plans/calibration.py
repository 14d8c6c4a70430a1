"""Thresholds from labelled pairs, and the pairs from a statement inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgauge.functions.text import concept_slug, file_stem, statement_key
from stepgauge.functions.vectors import Encoder, dot, encoded
from stepgauge.operators import metrics, sampling
from stepgauge.schemas import PAIR_SCORE_COLUMNS


def scored_pairs(templates: DataFrame, encoder: Encoder) -> DataFrame:
    """Each variant of each template with its cosine; only 'equivalent' should match."""
    rows = sampling.variants(templates.withColumnRenamed("id", "pair_id"))
    texts = rows.select(F.col("text_a").alias("text")).union(rows.select("text_b"))
    vectors = encoded(texts, encoder)
    for side in "ab":
        rows = rows.join(vectors.withColumnsRenamed({"text": f"text_{side}", "vector": f"v_{side}"}), f"text_{side}")
    return rows.withColumns({"cosine": dot(F.col("v_a"), F.col("v_b")), "expected_match": F.col("label") == "equivalent"}).drop("v_a", "v_b")


def calibrate(templates: DataFrame, encoder: Encoder, threshold: float | None = None, step: float = 0.01) -> dict[str, DataFrame]:
    """scores, summary and sweep of each language's pairs; a threshold that is given takes the place of the recommended one."""
    keys = ["language"]
    pairs = scored_pairs(templates, encoder)
    swept = metrics.sweep(pairs, step, keys)
    best = metrics.recommended(swept, keys)
    at = best.withColumn("threshold", F.lit(threshold).cast("double") if threshold is not None else F.col("recommended_threshold"))
    scores = pairs.join(F.broadcast(at.select("language", "threshold", "recommended_threshold")), "language")
    scores = scores.withColumn("predicted_match", F.col("cosine") >= F.col("threshold")).withColumn("correct_at_threshold", F.col("predicted_match") == F.col("expected_match"))
    balanced = scores.groupBy("language").agg(F.first("threshold").alias("selected_threshold"), F.first("recommended_threshold").alias("recommended_threshold"), F.round(metrics.threshold_metrics(F.col("threshold"))["balanced_accuracy"], 6).alias("selected_balanced_accuracy"))
    total = F.col("label") == "overall"
    summary = metrics.label_summary(scores, keys).join(balanced, "language")
    for c in ("selected_threshold", "recommended_threshold", "selected_balanced_accuracy"):
        summary = summary.withColumn(c, F.when(total, F.col(c)))
    return {"scores": scores.select(*PAIR_SCORE_COLUMNS), "summary": summary, "sweep": swept.drop("exact")}


def statement_rows_key() -> list:
    return [statement_key(F.col("source_file"), F.col("subquestion_index"), F.col("field"), F.col("atom_path"), F.col("text"))]


def seed_pairs(statements: DataFrame, count: int = 12, previous_statements: DataFrame | None = None, previous_templates: DataFrame | None = None, reselect: bool = False) -> dict[str, DataFrame]:
    """selected_statements and pair_templates of one language's inventory (STATEMENT_COLUMNS and pos).

    previous_*: an earlier set, whose statements, ids, concepts and variants are kept as far as they are still there.
    """
    key = statement_rows_key()
    old = None
    if previous_statements is not None:
        old = previous_statements.withColumn("__key", F.struct(key[0].alias("k0"))).withColumn("at", F.monotonically_increasing_id())
    picked = sampling.balanced(statements, key, "pos", count, None if reselect else old)
    if old is not None:
        before = old.groupBy("__key").agg(F.first("id").alias("id"), F.first("concept").alias("old_concept"))
        picked = picked.join(before, "__key", "left")
    else:
        picked = picked.withColumns({"id": F.lit(None).cast("string"), "old_concept": F.lit(None).cast("string")})
    named = sampling.stable_ids(picked, "pick", picked.select("id").where("id is not null"))
    concept = F.coalesce("old_concept", concept_slug(file_stem(F.col("source_file")), F.col("field"), F.col("id")))
    named = named.withColumns({"concept": concept, "type": F.lit("semantic")})
    older = None
    if previous_templates is not None and old is not None:
        own = previous_templates.select(F.col("source_statement_id").alias("id"), "label", "text_b_variants")
        older = own.join(old.select("id", "__key"), "id").select("__key", "label", "text_b_variants")
    pairs = sampling.templates(named.select("id", "__key", "concept", "text"), older)
    return {"selected_statements": named.select("id", "type", "concept", "field", "source_file", "subquestion_index", "atom_path", "text", "pick"), "pair_templates": pairs}
