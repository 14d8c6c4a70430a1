"""Parsing, flattening, repair and validation of proof trees."""

import pytest
from pyspark.sql import functions as F

from stepgauge.sources import config, files, proofs, sinks, trees

LATEX = r"""%@ASSUMPTION_GLOBAL Let $W$ be a process. %@CONTEXT
\titledquestion{Paths} \begin{parts}
\part % @ASSUMPTION It is continuous. % @ASSUMPTION_END Show it.
\begin{xsolution}
%@LIST_START
%@ATOM
%@PRECOND
$X_0=0$ and
%@PRECOND_END
%@ARGUMENT
and by symmetry. % note
%@OUTCOME
which directly gives \(x\).
%@STRENGTH: 0.5 sure
%@SET_START
%@ATOM
%@ARGUMENT:CALCUL
anything
%@ATOM_END
%@ATOM
%@ARGUMENT:CALCUL
%@ATOM_END
%@SET_END
%@LIST_END
\end{xsolution}
\part Second?"""


def test_annotated_latex():
    got = proofs.parse_exercise(LATEX)
    calc = {"preconditions": [], "arguments": ["Calculation"], "outcomes": []}
    first = {"preconditions": ["$X_0=0$"], "arguments": ["by symmetry"], "outcomes": [r"\(x\)"], "strength": 0.5}
    assert got["context"] == "Paths" and got["assumption_global"] == ["Let $W$ be a process."]
    assert got["subquestions"][0] == {"question": "It is continuous. Show it.", "assumptions": ["It is continuous"], "atoms": [first, (calc,)]}
    assert got["subquestions"][1] == {"question": "Second?", "assumptions": [], "atoms": []}
    assert trees.load_tagged(trees.dumped(got)) == got


@pytest.mark.parametrize("body,wrong", [
    ("%@LIST_START", "Unclosed @LIST_START"), ("%@SET_START\n%@LIST_END", "without matching @LIST_START"), ("%@ATOM\n%@PRECOND\nx", "Atom has no @ARGUMENT"),
    ("%@ATOM\n%@ARGUMENT\nx\n%@STRENGTH high", "Invalid @STRENGTH"),
])
def test_mistakes_in_annotations(spark, body, wrong):
    with pytest.raises(proofs.ProofError, match=wrong):
        proofs.proof(body)
    text = "\\part q\\begin{xsolution}" + body + "\\end{xsolution}"
    row = proofs.parsed(spark.createDataFrame([(text,)], "text string")).first()
    assert wrong in row.error and row.subquestions == []


def test_flattened_paths(spark):
    rows = proofs.parsed(spark.createDataFrame([("d", LATEX)], "id string, text string"))
    at = trees.atoms(rows, ["id"]).select("atom_index", trees.path(F.col("subquestion_index"), F.col("steps")).alias("p"), "strength").orderBy("atom_index").collect()
    assert [(r.atom_index, r.p, r.strength) for r in at] == [(1, "subquestions[1].atoms/list[1]", 0.5), (2, "subquestions[1].atoms/list[2]/set[1]", None)]


def test_split_atoms_are_put_together():
    p, a, o = {"preconditions": ["p"]}, {"arguments": ["a"]}, {"outcomes": ["o"]}
    assert trees.repaired({"x": [p, a, o, a, "text", a, a, o]}) == {"x": [p | a | o, a, "text", a, a | o]}
    assert trees.repaired((p, {"other": 1}, a)) == (p, {"other": 1}, a)


GOOD = {"preconditions": [], "arguments": ["a"], "outcomes": []}


@pytest.mark.parametrize("data,expected,fault", [
    ({"name": 1, "version": 2}, None, "forbidden top-level key(s): name, version."), ({}, None, "must contain a top-level 'subquestions' key"), ({"subquestions": {}}, None, "value must be a list"),
    ({"subquestions": []}, 2, "Expected exactly 2"), ({"subquestions": [1]}, 1, "subquestions[1] must be a mapping."), ({"subquestions": [{}]}, None, "subquestions[1] must contain an 'atoms' key."),
    ({"subquestions": [{"atoms": 3}]}, None, "subquestions[1].atoms must be an atom mapping, list, or !!python/tuple."), ({"subquestions": [{"atoms": [{"arguments": []}]}]}, None, "subquestions[1].atoms[1] is missing atom key(s): preconditions, outcomes."),
    ({"subquestions": [{"atoms": [GOOD | {"z": 1}]}]}, None, "unexpected key(s): z."), ({"subquestions": [{"atoms": GOOD | {"outcomes": "x"}}]}, None, "atoms.outcomes must be a list of strings."),
    ({"subquestions": [{"atoms": GOOD | {"outcomes": [1]}}]}, None, "outcomes[1] must be a string."), ({"subquestions": [{"atoms": GOOD | {"arguments": []}}]}, None, "at least one argument"),
    ({"subquestions": [{"atoms": GOOD | {"strength": "x"}}]}, None, "strength must be numeric."), ({"subquestions": [{"atoms": (GOOD, [GOOD])}]}, 1, None),
])
def test_the_first_fault_counts(data, expected, fault):
    got = next(trees.exercise_faults(data, expected), None)
    assert (got is None) if fault is None else fault in got


def test_one_question():
    assert trees.single_question({"atoms": [GOOD]}) == ([GOOD], None)
    assert trees.single_question({"subquestions": [{"atoms": GOOD}]}) == (GOOD, None)
    assert "exactly one" in trees.single_question({"subquestions": []})[1] and "'atoms' key" in trees.single_question({})[1]


def test_only_tuples_are_tagged():
    assert trees.first_mapping("a: !!python/tuple [1, 2]") == ({"a": (1, 2)}, None)
    assert trees.first_mapping("a: !!python/object/apply:os.getcwd []")[0] is None
    assert trees.first_mapping("---\n---\nb: 1") == ({"b": 1}, None) and trees.first_mapping("")[1] and trees.first_mapping("- x")[1]


def test_scans_and_exports(spark, tmp_path):
    for name in ("in/pc1_q2_en.tex", "in/deep/pc1_q2_fr.tex", "in/pc1_q2_en_old.tex", "in/pcx_q1_en.tex"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("é\nline")
    rows = files.downloaded_tex(spark, str(tmp_path / "in"))
    assert sorted(r.target for r in rows.collect()) == ["en/pc1_q2.tex", "fr/pc1_q2.tex"]
    assert sinks.export(rows, str(tmp_path / "out")) == {"written": 2, "skipped": 0}
    assert sinks.export(rows, str(tmp_path / "out"), overwrite=False) == {"written": 0, "skipped": 2}
    assert (tmp_path / "out/fr/pc1_q2.tex").read_text() == "é\nline"
    with pytest.raises(files.ScanError):
        files.predictions(spark, str(tmp_path / "out"))
    sinks.write_error_report(str(tmp_path / "e.yaml"), {"failed": 1}, [{"x": 1}])
    assert (tmp_path / "e.yaml").exists()
    sinks.write_error_report(str(tmp_path / "e.yaml"), {}, [])
    assert not (tmp_path / "e.yaml").exists()


def test_answers_tell_their_strategy(spark, tmp_path):
    at = tmp_path / "plain_text/m/en/baseline"
    at.mkdir(parents=True)
    (at / "pc1_q1_seq.txt").write_text("Prompt type: self_history\nx")
    (at / "pc1_q1_acc.txt").write_text("x")
    (at / "pc1_q3.txt").write_text("x")
    got = {r.path.rsplit("/")[-1]: (r.strategy, r.strategy_abbreviation) for r in files.answers(spark, str(tmp_path)).collect()}
    assert got == {"pc1_q1_seq.txt": ("self_history", "seq"), "pc1_q1_acc.txt": ("prompt_accumulation", "acc"), "pc1_q3.txt": ("unknown", "unknown")}


def test_csv_keeps_empty_fields(spark, tmp_path):
    rows = spark.createDataFrame([("a,\"b\n", None, True, 0.5)], "x string, y string, ok boolean, s double")
    sinks.write_csv(rows, str(tmp_path / "t.csv"), ["s", "x", "y", "ok", "more"], 1)
    text = next((tmp_path / "t.csv").glob("part*")).read_text()
    assert text.splitlines()[0] == "s,x,y,ok,more" and text.endswith(",,True,\n") and text.split("\n", 1)[1].startswith("0.500000,")


def test_settings():
    assert config.weights({"ranking": {"weights": {"formula_fidelity": 1}}})["formula_fidelity"] == 1.0
    for wrong in ({"zzz": 1}, {"formula_fidelity": -1}, dict.fromkeys(config.RANKING_WEIGHTS, 0)):
        with pytest.raises(config.SettingsError):
            config.weights({"ranking": {"weights": wrong}})
    with pytest.raises(config.SettingsError):
        config.enabled_models({"models": [{"enabled": False}]})
    with pytest.raises(config.SettingsError):
        config.check_generation({"input": {"filters": {"prompt_types": ["a"]}}})
    with pytest.raises(config.SettingsError, match="one path"):
        config.check_generation({})
    assert config.lookup({"a": {"b": 0}}, "a.b", 1) == 0 and config.lookup({}, "a.b", 1) == 1 and config.chosen(None, {"a": 2}, "a") == 2
