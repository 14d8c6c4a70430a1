"""Ids whose numbers outgrow their digits."""

from stepgauge.operators import sampling


def test_ids_are_padded_and_never_cut(spark):
    rows = spark.range(30).selectExpr("id as doc_id", "if(id = 3, 'doc_12', null) as id")
    got = sampling.stable_ids(rows, "doc_id", rows.where("id is not null").select("id"), "doc_", 1).collect()
    assert sorted(int(r.id[4:]) for r in got) == list(range(1, 31))
