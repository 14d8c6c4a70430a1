"""Evaluation of predictions: matrices, best matches, order, case summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgauge.functions.rewrite import statements
from stepgauge.functions.text import display
from stepgauge.functions.vectors import Encoder, encoded, texts_of, with_vectors
from stepgauge.operators import align, coverage, judge, metrics, order
from stepgauge.operators.align import SOURCES
from stepgauge.schemas import BEST_COLUMNS, CASE, DIMENSIONS, MATRIX_COLUMNS, ORDER_COLUMNS
from stepgauge.sources import trees
from stepgauge.sources.scratch import kept

SUB = [*CASE, "subquestion_index"]


def _texts(c: str) -> Column:
    """A field's texts; unlike required statements they are not trimmed."""
    return F.filter(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull())


def required_statements(reference: DataFrame, keys: list[str], subquestions: DataFrame) -> DataFrame:
    """keys, subquestion_index, gt_atom_index, gt_source, path, text: what a prediction's preconditions should cover.

    subquestions (keys, subquestion_index): all that either side has; those that
    only the prediction has want the globals and all outcomes.
    """
    sub_key = [*keys, "subquestion_index"]
    every = subquestions.select(*sub_key).distinct()
    place = lambda *c: F.array(*[x.cast("int") for x in c])
    globals_ = reference.select(*keys, F.posexplode(statements(F.col("assumption_global"))).alias("n", "text")).withColumn("place", place(F.col("n"))).join(every, keys)
    globals_ = globals_.withColumn("path", F.format_string("assumption_global[%d]", F.col("n") + 1))
    subs = reference.select(*keys, F.posexplode("subquestions").alias("m", "sub")).withColumn("subquestion_index", F.col("m") + 1)
    local = subs.select(*sub_key, F.posexplode(statements(F.col("sub.assumptions"))).alias("n", "text")).withColumn("place", place(F.col("n")))
    local = local.withColumn("path", F.format_string("subquestions[%d].assumptions[%d]", "subquestion_index", F.col("n") + 1))
    atoms = trees.atoms(reference, keys)
    at = trees.path(F.col("subquestion_index"), F.col("steps"))
    said = atoms.select(*sub_key, "atom_index", at.alias("at"), F.posexplode(statements(F.col("outcomes"))).alias("n", "text"))
    first = said.groupBy(*keys, "text").agg(F.min(F.struct("subquestion_index", "atom_index", "n", "at")).alias("f"))
    outcomes = first.select(*keys, "text", F.col("f.subquestion_index").alias("since"), place(F.col("f.subquestion_index"), F.col("f.atom_index"), F.col("f.n")).alias("place"), F.concat("f.at", F.format_string(".outcomes[%d]", F.col("f.n") + 1)).alias("path"))
    outcomes = outcomes.join(every, keys).where("since < subquestion_index")
    needs = atoms.select(*sub_key, "atom_index", at.alias("at"), F.posexplode(statements(F.col("preconditions"))).alias("n", "text"))
    needs = needs.withColumns({"place": place(F.col("atom_index"), F.col("n")), "path": F.concat("at", F.format_string(".preconditions[%d]", F.col("n") + 1))})
    pack = lambda rows: rows.select(*sub_key, F.struct("place", "path").alias("place"), "text")
    out = align.required(dict(zip(SOURCES, map(pack, (globals_, local, outcomes, needs)), strict=True)), sub_key)
    return out.select(*sub_key, "gt_atom_index", "gt_source", F.col("place.path").alias("path"), "text")


def matched_atoms(predictions: DataFrame, reference: DataFrame, encoder: Encoder, threshold: Column, subquestions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole matrix: outcomes (D1), arguments (D3) and required statements (D4) against the predicted atoms; and the paths and texts of both sides.

    Texts are not repeated for each pair: ``named_pairs`` joins them where they are wanted.  reference has the predictions' case columns already; threshold is a column over them.
    """
    path = trees.path(F.col("subquestion_index"), F.col("steps"))
    atoms = lambda rows: trees.atoms(rows, CASE).select(*SUB, "atom_index", path.alias("path"), *[_texts(f).alias(f) for f in trees.ATOM_FIELDS])
    fields = {f"v_{f}": f for f in trees.ATOM_FIELDS}
    # atoms and statements are read for their texts and for each dimension; a text is encoded once for all of them
    theirs, own = kept(atoms(reference), "references"), kept(atoms(predictions), "predicted")
    targets = kept(required_statements(reference, CASE, subquestions).withColumn("__one", F.array("text")), "targets")
    texts = texts_of(theirs, *DIMENSIONS.values()).unionByName(texts_of(own, *fields.values())).unionByName(targets.select("text"))
    vectors = kept(encoded(texts, encoder), "vectors")
    gt = kept(with_vectors(theirs, [*SUB, "atom_index"], {k: v for k, v in fields.items() if v in DIMENSIONS.values()}, None, vectors), "references")
    model = kept(with_vectors(own, [*SUB, "atom_index"], fields, None, vectors), "predicted")
    targets = kept(with_vectors(targets, [*SUB, "gt_atom_index"], {"gt_vectors": "__one"}, None, vectors), "targets")
    named = lambda rows, i, dimension, *more: rows.select(*SUB, F.lit(dimension).alias("dimension"), F.col("atom_index").alias(i), *more)
    out = asked = offered = None
    for dimension, field in DIMENSIONS.items():
        left = gt.select(*SUB, F.col("atom_index").alias("gt_atom_index"), F.col(f"v_{field}").alias("gt_vectors"))
        right = model.select(*SUB, F.col("atom_index").alias("model_atom_index"), F.col(f"v_{field}").alias("model_vectors"))
        rows = align.matrix(left, right, SUB, threshold).withColumns({"dimension": F.lit(dimension), "field": F.lit(field), "gt_source": F.lit(None).cast("string")})
        out = rows if out is None else out.unionByName(rows)
        names = named(gt, "gt_atom_index", dimension, F.col("path").alias("gt_atom_path"), display(F.col(field)).alias("gt_text"))
        asked = names if asked is None else asked.unionByName(names)
        names = named(model, "model_atom_index", dimension, F.col("path").alias("model_atom_path"), display(F.col(field)).alias("model_text"))
        offered = names if offered is None else offered.unionByName(names)
    left = targets.select(*SUB, "gt_atom_index", "gt_source", "gt_vectors")
    right = model.select(*SUB, F.col("atom_index").alias("model_atom_index"), F.col("v_preconditions").alias("model_vectors"))
    rows = align.targets_matrix(left, right, SUB, threshold).withColumns({"dimension": F.lit("D4"), "field": F.lit("required_precondition_coverage")})
    asked = asked.unionByName(targets.select(*SUB, F.lit("D4").alias("dimension"), "gt_atom_index", F.col("path").alias("gt_atom_path"), F.col("text").alias("gt_text")))
    offered = offered.unionByName(named(model, "model_atom_index", "D4", F.col("path").alias("model_atom_path"), display(F.col("preconditions")).alias("model_text")))
    return out.unionByName(rows), asked, offered


def named_pairs(matrix: DataFrame, asked: DataFrame, offered: DataFrame) -> DataFrame:
    """A matrix with its atoms' paths and texts."""
    return matrix.join(asked.distinct(), [*SUB, "dimension", "gt_atom_index"], "left").join(offered.distinct(), [*SUB, "dimension", "model_atom_index"], "left")


def evaluate(
    predictions: DataFrame,
    ground_truth: DataFrame,
    encoder: Encoder,
    threshold: Column | None = None,
    expected: dict[str, list[str]] | None = None,
    second: judge.Judge | None = None,
    band: tuple[Column | float, Column | float] = (0.375, 1.0),
    template: str = "",
    judge_model: str = "judge",
    known_decisions: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of an evaluation.

    predictions: prediction_path, the case and the EXERCISE columns;
    ground_truth: language, exercise and the EXERCISE columns.
    """
    limit = threshold if threshold is not None else F.lit(0.415)
    gt = ground_truth.select("language", "exercise", *[F.col(c).alias(f"gt_{c}") for c in ("context", "assumption_global", "subquestions", "error")])
    cases = predictions.join(gt, ["language", "exercise"], "left")
    wrong = F.coalesce(F.col("error"), F.when(F.col("gt_subquestions").isNull(), "there is no ground truth"), F.col("gt_error"))
    cases = cases.withColumn("__wrong", wrong)
    good = cases.where("__wrong is null")
    reference = good.select(*CASE, F.col("gt_assumption_global").alias("assumption_global"), F.col("gt_subquestions").alias("subquestions"))
    numbers = F.explode(F.when(F.greatest(F.size("subquestions"), F.size("gt_subquestions")) > 0, F.sequence(F.lit(1), F.greatest(F.size("subquestions"), F.size("gt_subquestions")))))
    subquestions = good.select(*CASE, numbers.alias("subquestion_index"))
    matrix, *names = matched_atoms(good, reference, encoder, limit, subquestions)
    decisions = None
    if second is None:
        matrix = judge.unjudged(matrix)
    else:
        # a decision's key has the texts
        matrix = judge.keyed(named_pairs(matrix, *names), template, judge_model)
        known = known_decisions if known_decisions is not None else predictions.sparkSession.createDataFrame([], judge.DECISION)
        asking = matrix.where(judge.in_band(F.col("score"), *band, F.col("model_atom_index")))
        fresh = kept(judge.decide(asking, known, template, second), "decisions")  # the matrix and the cache have the same answers
        decisions = known.select("cache_key", "label", "confidence", "reason", "raw_response").join(asking.select("cache_key").distinct(), "cache_key", "left_semi").withColumn("cache_hit", F.lit(True)).unionByName(fresh.withColumn("cache_hit", F.lit(False)))
        matrix = judge.applied(matrix, decisions, *band).drop("gt_atom_path", "gt_text", "model_atom_path", "model_text")
    matrix = kept(matrix, "matrix")  # six tables are made from it
    return tables(cases, matrix, reference, limit, names) | coverage_tables(predictions, ground_truth, expected or {}) | ({"decisions": decisions} if decisions is not None else {})


def tables(cases: DataFrame, matrix: DataFrame, reference: DataFrame, threshold: Column, names: list[DataFrame]) -> dict[str, DataFrame]:
    """What follows from a matrix: best matches, order constraints, case and source summaries."""
    gt_atoms = trees.atoms(reference, CASE).select(*SUB, F.col("atom_index").alias("gt_atom_index"), "steps")
    everything = None
    for dimension, field in DIMENSIONS.items():
        part = gt_atoms.select(*SUB, "gt_atom_index", F.lit(dimension).alias("dimension"), F.lit(field).alias("field"), F.lit(None).cast("string").alias("gt_source"))
        everything = part if everything is None else everything.unionByName(part)
    targets = matrix.where("dimension = 'D4'").select(*SUB, "gt_atom_index", "dimension", "field", "gt_source").distinct()
    everything = everything.unionByName(targets)
    item = [*SUB, "dimension"]
    best = align.best_matches(matrix, item)
    best = everything.join(best, [*item, "gt_atom_index"], "left").withColumns({"best_score": F.coalesce("best_score", F.lit(0.0)), "matched": F.coalesce("matched", F.lit(False))})

    rules = order.constraints(gt_atoms.withColumnRenamed("gt_atom_index", "atom_index"), SUB)
    pairs = metrics.combined_scores(matrix.where("dimension in ('D1', 'D3')"), SUB)
    judged = order.status(rules, order.placed(pairs, SUB, threshold), SUB)
    paths = gt_atoms.select(*SUB, "gt_atom_index", trees.path(F.col("subquestion_index"), F.col("steps")).alias("p"))
    for side in ("before", "after"):
        judged = judged.join(paths.select(*SUB, F.col("gt_atom_index").alias(f"{side}_gt_atom_index"), F.col("p").alias(f"{side}_gt_atom_path")), [*SUB, f"{side}_gt_atom_index"], "left")
    orders = order.summary(judged, CASE, cases.where("__wrong is null"))

    summary = metrics.dimension_summary(matrix, [*CASE, "dimension"], ["subquestion_index"])
    wide = summary.groupBy(*CASE).pivot("dimension", ["D1", "D3", "D4"]).agg(*[F.first(m).alias(m) for m in metrics.METRICS])
    scores = [f"{d}_{m}" for d in ("D1", "D3", "D4") for m in metrics.METRICS]
    out = cases.select("prediction_path", *CASE, F.when(F.col("__wrong").isNull(), "ok").otherwise("failed").alias("status"), F.col("__wrong").alias("error"))
    out = out.join(wide, CASE, "left").join(orders, CASE, "left")
    fine = F.col("status") == "ok"
    out = out.withColumns({c: F.when(fine, F.coalesce(c, F.lit(0.0))) for c in scores})
    out = out.withColumnsRenamed({c: f"D2_{c}" for c in ("order_score", "order_coverage", "strict_order_score", "total_constraints", "respected_constraints", "violated_constraints", "unmatched_constraints")})
    out = out.withColumns(metrics.overall(F.col("D1_mean_best_score"), F.col("D3_mean_best_score"), F.col("D4_mean_best_score"), F.col("D2_strict_order_score")))
    sources = metrics.source_summary(matrix.where("dimension = 'D4'"), CASE, ["subquestion_index"])
    return {
        "matrix": named_pairs(matrix, *names).select(*CASE, *MATRIX_COLUMNS), "best_matches": best.select(*CASE, *BEST_COLUMNS), "order": judged.select(*CASE, *ORDER_COLUMNS), "summary": out,
        "sources": sources, "by_model": group_report(out, sources, ["language", "variation", "call1_model"]), "by_model_strategy": group_report(out, sources, ["language", "variation", "call1_model", "strategy"]),
    }


def group_report(cases: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """One level of the report, with the sources' columns."""
    return metrics.report(cases, keys).join(metrics.source_columns(sources, keys), keys, "left")


def coverage_tables(predictions: DataFrame, ground_truth: DataFrame, expected: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Which of the expected cases were found."""
    wanted = coverage.expected(*coverage.axes(predictions, ground_truth, expected))
    return {"coverage": coverage.found_or_missing(wanted, predictions.select(*CASE, "prediction_path"), CASE)}


def with_coverage(report: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """A report with its counts of expected cases and its scores times the share found."""
    both = report.join(metrics.coverage_columns(covered, keys), keys, "left").na.fill(0, ["expected_cases", "found_cases", "missing_cases"])
    return metrics.end_to_end(both, ["overall_mean_score", "overall_with_D2_score"])


def atom_matrices(ground_truth: DataFrame, predictions: DataFrame, encoder: Encoder, threshold: float = 0.75) -> dict[str, DataFrame]:
    """The matrix and best matches of outcomes and arguments alone, at one threshold."""
    tables_ = evaluate(predictions, ground_truth, encoder, F.lit(threshold))
    only = F.col("dimension").isin("D1", "D3")
    return {k: tables_[k].where(only) for k in ("matrix", "best_matches")}

