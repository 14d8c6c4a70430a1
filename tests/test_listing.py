"""Trees of files: what is listed, read and left."""

import os

import pytest

from stepgauge.plans.round_trips import scan_annotated, synchronized_outputs
from stepgauge.sources import files, listing, sinks


@pytest.fixture
def tree(tmp_path):
    for name, text in {"en/a/pc1_q1.yaml": "one", "en/pc2_q1.yml": "", "fr/deep/er/pc3_q1.yaml": "é\n", "pc4_q1.yaml": "", "en/note.txt": "no", ".hidden/pc5_q1.yaml": "x", "_temporary/pc6_q1.yaml": "x", "en/.pc7_q1.yaml.tmp": "x", "en/_x.yaml": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


WANT = {"en/a/pc1_q1.yaml": "one", "en/pc2_q1.yml": "", "fr/deep/er/pc3_q1.yaml": "é\n", "pc4_q1.yaml": ""}


@pytest.mark.parametrize("first", [1, 3, 2000])
def test_all_files_are_read_empty_ones_too(spark, tree, monkeypatch, first):
    monkeypatch.setattr(listing, "FIRST", first)
    for root in (tree, tree + "/", f"file://{tree}"):
        assert {r.path: r.text for r in files.texts(spark, root, "*.{yaml,yml}", ordered=first == 3).collect()} == WANT
    assert {r.target for r in sinks.existing(spark, tree).collect()} == {*WANT, "en/note.txt"}
    assert {r.path: r.text for r in files._by_spark(spark, tree, "*.{yaml,yml}").collect()} == WANT


def test_a_root_that_is_a_file_or_is_not_there(spark, tree):
    assert [tuple(r) for r in files.texts(spark, f"{tree}/en/note.txt").collect()] == [("", "no")]
    assert sinks.existing(spark, f"{tree}/none").count() == 0
    with pytest.raises(files.ScanError):
        files.texts(spark, f"{tree}/none")


def test_files_are_read_only_where_their_text_is_wanted(spark, tree):
    os.symlink(f"{tree}/gone", f"{tree}/en/pc8_q1.yaml")  # reading it would fail
    assert files.texts(spark, tree, "*.yaml").drop("text").count() == 4
    assert files.texts(spark, tree, "*.yaml").where("path not like '%pc8%'").where("text <> ''").count() == 2


def test_small_files_share_tasks(spark, tmp_path):
    rows = spark.range(600).selectExpr("concat('d', id % 3, '/f', id, '.txt') as target", "repeat('x', cast(id % 5 as int)) as text")
    assert sinks.export(rows, str(tmp_path)) == {"written": 600, "skipped": 0}
    read = files.texts(spark, str(tmp_path), "*.txt")
    assert read.rdd.getNumPartitions() <= 3 and read.selectExpr("count(*)", "sum(length(text))").first() == (600, 1200)
    assert sinks.export(rows, str(tmp_path), overwrite=False) == {"written": 0, "skipped": 600}


def test_empty_documents_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "", "en"), (2, "", "en"), (3, "a", "fr")], "doc_id long, text string, lang string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.target for r in scan_annotated(spark, str(tmp_path)).collect()} == {"en/1/d1.yaml", "en/2/d2.yaml", "fr/3/d3.yaml"}
    assert {r.target for r in synchronized_outputs(spark, str(tmp_path)).collect()} == {"en/d1.txt", "en/d2.txt"}
