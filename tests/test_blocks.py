"""Blocks of pairs against the expression on columns, and what is taken out of them."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepgauge.functions.measures import rounded, rounded_fast
from stepgauge.functions.vectors import coverage
from stepgauge.operators import align, blocks, judge, metrics

VECTORS = "array<array<float>>"


def sides(spark, odd=False):
    rng = np.random.default_rng(5)
    vector = lambda d=6: [float(np.float32(x)) for x in rng.normal(size=d)]
    vectors = lambda: [vector() for _ in range(rng.integers(0 if odd else 1, 4 if odd else 2))]
    left = [("a" if n % 4 else "b", n, f"s{n % 3}", vectors()) for n in range(70)]
    right = [("a" if n % 3 else "b", n, vectors()) for n in range(90)]
    if odd:
        left += [("a", 100, "s0", None), ("a", 101, "s1", [None]), ("a", 102, "s1", [vector(5), vector()]), (None, 103, "s2", vectors()), ("alone", 104, "s2", vectors()), ("a", 105, "s0", [])]
        right += [("a", 100, None), ("a", 101, []), ("a", 102, [vector(5), None]), (None, 103, vectors()), ("b", 104, [[1.0, None, 0.0, 0.0, 0.0, 0.0]])]
    left += [("tie", 200 + n, "s1", [[1.0, 0.0, 0.0]]) for n in range(9)]
    right += [("tie", 200 + n, [[0.5 if n == 3 else 0.75, 0.0, 0.0]]) for n in range(9)]
    a = spark.createDataFrame(left, f"k string, gt_atom_index long, gt_source string, gt_vectors {VECTORS}")
    return a, spark.createDataFrame(right, f"k string, model_atom_index long, model_vectors {VECTORS}")


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("chunk", [7, 4096])
def test_blocks_are_the_expression_on_columns(spark, monkeypatch, odd, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    a, b = sides(spark, odd)
    cosine = coverage(F.col("gt_vectors"), F.col("model_vectors"))
    want = a.join(b, "k").select("k", "gt_atom_index", "gt_source", "model_atom_index", cosine.alias("c"), rounded(cosine).alias("s"), (cosine >= 0.25).alias("m"))
    got = align.matrix(a, b, ["k"], 0.25)
    got = got.select("k", "gt_atom_index", "gt_source", "model_atom_index", "score", "matched")
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert rows(got) == rows(want.drop("c"))
    exact = blocks.pairs(a, b, ["k"]).select("gt_atom_index", "model_atom_index", "cosine")
    assert rows(exact) == rows(want.select("gt_atom_index", "model_atom_index", "c"))
    band = align.matrix(a, b, ["k"], 0.25, (0.1, 0.4)).select("gt_atom_index", "model_atom_index")
    assert rows(band) == rows(want.where("s between 0.1 and 0.4").select("gt_atom_index", "model_atom_index"))
    alone = align.targets_matrix(a, b, ["k"], 0.25).where("model_atom_index is null").select("gt_atom_index", "score", "matched")
    assert rows(alone) == sorted(repr((n, 0.0, False)) for n in ((103, 104) if odd else ()))


@pytest.mark.parametrize("odd", [False, True])
def test_best_matches_need_no_matrix(spark, monkeypatch, odd):
    monkeypatch.setattr(blocks, "CHUNK", 7)
    a, b = sides(spark, odd)
    matrix = align.matrix(a, b, ["k"], 0.25)
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    found, offered = align.matched_items(a, b, ["k"], 0.25)
    assert rows(align.named_best(found, ["k"])) == rows(align.best_matches(matrix, ["k"]))
    assert {r.best_model_atom_index for r in align.named_best(found, ["k"]).where("k = 'tie'").collect()} == {200}
    assert rows(metrics.items_summary(found, offered, ["k"])) == rows(metrics.dimension_summary(matrix, ["k"]))
    by_source = metrics.items_summary(*align.matched_items(a, b, ["k"], 0.25, ["gt_source"]), ["k", "gt_source"])
    assert rows(by_source) == rows(metrics.source_summary(matrix, ["k"]))


def test_a_large_key_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 7)
    a, b = sides(spark)
    a, b = a.where("k = 'a'"), b.where("k = 'a'")
    tasks = align.matrix(a, b, ["k"], 0.25).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < a.count() * b.count() / 2


def test_rounding_near_halves():
    values = np.array([0.1234565, -0.1234565, 0.1234564999999, 0.12345649999951, -4e-7, 0.0, 2.5e-6, 123456789.1234565, 1e12 + 0.25, -np.inf, 0.25])
    want = [float(Decimal(repr(float(x))).quantize(Decimal("1e-12"), ROUND_HALF_UP).quantize(Decimal("1e-6"), ROUND_HALF_UP)) if np.isfinite(x) else x for x in values]
    assert blocks.rounded(values).tolist() == want


def test_fast_rounding(spark):
    values = [0.1234565, -0.1234565, 0.12345649999951, 4e-7, 2.5e-6, 123456789.1234565, None, 0.25, -0.3333333]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(rounded("x"), rounded_fast(F.col("x"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_combined_score_of_a_row(spark):
    rows = spark.createDataFrame([(0.5, 0.25), (0.5, None), (None, None)], "a double, b double")
    assert [r[0] for r in rows.select(metrics.combined_score(F.col("a"), F.col("b"))).collect()] == [0.375, 0.5, None]


def test_pairs_outside_the_band_are_not_joined(spark):
    rows = spark.createDataFrame([("x", 1, 0.2, False), ("y", 2, 0.3, True), ("z", 3, 0.9, True), ("u", 4, 0.05, False), ("v", None, 0.2, False)], "cache_key string, model_atom_index long, score double, matched boolean")
    decisions = spark.createDataFrame([("x", "equivalent", 0.5, "so", False), ("z", "unrelated", 0.5, "so", False)], "cache_key string, label string, confidence double, reason string, cache_hit boolean")
    out = judge.applied(rows, decisions, 0.1, 0.4)
    assert sorted(((r.model_atom_index or 0), r.score, r.matched, r.judge_used, r.judge_cache_key) for r in out.collect()) == [(0, 0.2, False, False, None), (1, 1.0, True, True, "x"), (2, 0.3, True, False, "y"), (3, 0.9, True, False, None), (4, 0.05, False, False, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "isnotnull(" in plan.split("Join")[1]
