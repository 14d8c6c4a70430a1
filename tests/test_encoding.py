"""An evaluation encodes each text once, for all dimensions."""

import uuid
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from stepgauge.functions.vectors import hashing_encoder
from stepgauge.plans import evaluation
from tests.test_plans import case, exercise


def test_a_text_is_encoded_once(spark, tmp_path):
    plain, folder = hashing_encoder(), str(tmp_path)

    def encode(texts):
        Path(folder, uuid.uuid4().hex).write_text("\0".join(texts), encoding="utf-8")
        return plain(texts)

    out = evaluation.evaluate(case(spark), exercise(spark, language="en", exercise="pc1_q1"), encode, F.lit(0.9))
    seen = Counter(t for p in tmp_path.iterdir() for t in p.read_text(encoding="utf-8").split("\0"))
    assert seen and set(seen.values()) == {1}
    rows = out["matrix"].collect()
    assert all(r.gt_text and r.gt_atom_path for r in rows if r.dimension == "D4") and {r.dimension for r in rows} == {"D1", "D3", "D4"}
