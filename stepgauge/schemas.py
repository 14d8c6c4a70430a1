"""The relations that the plans exchange.

An exercise (or a prediction) is one row.  Its nested proof becomes a flat array
of atoms; where an atom hangs in the proof is told by ``steps``, one entry for
each container above it: whether that is ordered (``list``) or not (``set``), and
the place of the child that leads to the atom, from 1.
"""

from __future__ import annotations

import pyarrow as pa

STEP = "struct<kind:string,child:int>"
ATOM = f"struct<atom_index:int,steps:array<{STEP}>,preconditions:array<string>,arguments:array<string>,outcomes:array<string>,strength:double>"
SUBQUESTION = f"struct<question:string,assumptions:array<string>,answer:string,atoms:array<{ATOM}>>"
EXERCISE = f"struct<context:string,assumption_global:array<string>,subquestions:array<{SUBQUESTION}>,error:string>"

_TEXTS = pa.list_(pa.string())
_ATOM = pa.struct([("atom_index", pa.int32()), ("steps", pa.list_(pa.struct([("kind", pa.string()), ("child", pa.int32())]))), ("preconditions", _TEXTS), ("arguments", _TEXTS), ("outcomes", _TEXTS), ("strength", pa.float64())])
_SUBQUESTION = pa.struct([("question", pa.string()), ("assumptions", _TEXTS), ("answer", pa.string()), ("atoms", pa.list_(_ATOM))])
#: EXERCISE as the parsers hand it to Spark.
ARROW_EXERCISE = pa.struct([("context", pa.string()), ("assumption_global", _TEXTS), ("subquestions", pa.list_(_SUBQUESTION)), ("error", pa.string())])

#: What names a case: one generated answer to one exercise.
CASE = ["call1_model", "language", "variation", "exercise", "strategy"]
#: What names the generated answer that conversions compete for.
RESPONSE = ["call1_model", "language", "variation", "pc", "exercise", "strategy_abbreviation"]

DIMENSIONS = {"D1": "outcomes", "D3": "arguments"}
ATOM_FIELDS = ["preconditions", "arguments", "outcomes"]

# Column orders of the written reports.
MATRIX_COLUMNS = [
    "subquestion_index", "dimension", "field", "gt_atom_index", "model_atom_index", "gt_atom_path", "model_atom_path",
    "gt_source", "embedding_score", "score", "matched", "judge_used", "judge_label", "judge_confidence", "judge_reason",
    "judge_cache_key", "judge_cache_hit", "judge_error", "gt_text", "model_text",
]
BEST_COLUMNS = ["subquestion_index", "dimension", "field", "gt_atom_index", "gt_source", "best_model_atom_index", "best_score", "matched"]
ORDER_COLUMNS = [
    "subquestion_index", "constraint_index", "before_gt_atom_index", "after_gt_atom_index", "before_gt_atom_path", "after_gt_atom_path",
    "before_model_atom_index", "after_model_atom_index", "before_match_score", "after_match_score", "status", "respected",
]
COVERAGE_COLUMNS = ["status", *CASE, "prediction_path"]
STATEMENT_COLUMNS = ["source_file", "language", "pc", "exercise", "subquestion_index", "field", "atom_path", "text"]
PAIR_SCORE_COLUMNS = [
    "language", "pair_id", "source_statement_id", "concept", "label", "variant_index", "cosine", "threshold",
    "recommended_threshold", "predicted_match", "expected_match", "correct_at_threshold", "text_a", "text_b",
]
