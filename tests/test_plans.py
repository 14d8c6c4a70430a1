"""Operators and plans on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from stepgauge.functions.ranking import numbered
from stepgauge.functions.vectors import hashing_encoder
from stepgauge.operators import align, generate, judge, metrics, order, sampling
from stepgauge.plans import calibration, conversion, evaluation, inventory, selecting
from stepgauge.sources import trees
from stepgauge.streaming import incremental

GT = """
context: ''
assumption_global: [Let W be a process, ' Let W be a process ']
subquestions:
- question: q1
  assumptions: [it is bounded]
  atoms:
  - {preconditions: [a b], arguments: [c d], outcomes: [e f]}
  - {preconditions: [e f], arguments: [g h], outcomes: [i j]}
- question: q2
  assumptions: []
  atoms: !!python/tuple
  - {preconditions: [], arguments: [k l], outcomes: []}
  - {preconditions: [], arguments: [m n], outcomes: [o p]}
"""


def exercise(spark, text=GT, **keys):
    rows = spark.createDataFrame([(*keys.values(), text)], ", ".join(f"{k} string" for k in [*keys, "text"]))
    return trees.parsed(rows)


def case(spark, text=GT, exercise_="pc1_q1", model="m"):
    return exercise(spark, text, prediction_path=f"{model}/x", call1_model=model, language="en", variation="baseline", exercise=exercise_, strategy="seq")


def test_a_prediction_that_says_the_same(spark):
    result = evaluation.evaluate(case(spark), exercise(spark, language="en", exercise="pc1_q1"), hashing_encoder(), F.lit(0.9))
    row = result["summary"].first()
    assert (row.status, row.D1_mean_best_score, row.D3_f1, row.D1_coverage) == ("ok", 1.0, 1.0, 1.0)
    assert (row.D2_total_constraints, row.D2_strict_order_score) == (1, 1.0)
    targets = {(r.subquestion_index, r.gt_atom_index, r.gt_source, r.gt_text) for r in result["matrix"].where("dimension = 'D4'").collect()}
    assert targets == {(1, 1, "global_assumption", "Let W be a process"), (1, 2, "local_assumption", "it is bounded"), (1, 3, "gt_precondition", "a b"), (1, 4, "gt_precondition", "e f"), (2, 1, "global_assumption", "Let W be a process"), (2, 2, "previous_outcome", "e f"), (2, 3, "previous_outcome", "i j")}
    assert result["coverage"].first().status == "found"


def test_no_atoms_and_no_reference(spark):
    empty = "subquestions: [{atoms: []}, {atoms: []}, {atoms: []}]"
    both = case(spark, empty).unionByName(case(spark, exercise_="pc9_q9", model="n"))
    rows = {r.call1_model: r for r in evaluation.evaluate(both, exercise(spark, language="en", exercise="pc1_q1"), hashing_encoder())["summary"].collect()}
    assert rows["n"].status == "failed" and rows["n"].D1_f1 is None
    # the dimensions drop out, required statements count as missed, also those of the extra question
    assert (rows["m"].D1_mean_best_score, rows["m"].D4_mean_best_score, rows["m"].D4_coverage) == (0.0, 0.0, 0.0)


def test_judge_decisions(spark):
    asked = []

    def answer(prompt):
        if "i j" in prompt:
            raise RuntimeError("no answer")
        return "label: related_but_not_equivalent\nconfidence: 7"

    run = lambda known=None: evaluation.evaluate(case(spark), exercise(spark, language="en", exercise="pc1_q1"), hashing_encoder(), F.lit(0.9), second=answer, band=(0.9, 1.0), template="$gt_text | $model_text", known_decisions=known)
    first = run()
    rows = first["matrix"].where("judge_used").collect()
    assert rows and all(r.score == 0.5 and not r.matched and r.judge_confidence == 1.0 for r in rows if not r.judge_error) and any(r.judge_error == "no answer" and r.score == 1.0 for r in rows)
    again = run(first["decisions"].drop("cache_hit"))
    assert judge.counters(again["decisions"]).first().calls == 0
    assert not asked


def test_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 3, 0.5, True), (1, 1, 2, 0.5, False), (1, 2, 1, 0.1, False)], "k int, gt_atom_index int, model_atom_index int, score double, matched boolean")
    got = {r.gt_atom_index: r.best_model_atom_index for r in align.best_matches(rows, ["k"]).collect()}
    assert got == {1: 2, 2: 1}
    summary = metrics.dimension_summary(rows, ["k"]).first()
    assert (summary.coverage, summary.precision) == (0.0, round(1 / 3, 6))


def test_order_in_nested_containers(spark):
    steps = lambda *s: [dict(zip(("kind", "child"), x, strict=True)) for x in s]
    atoms = [(1, steps(("list", 1))), (2, steps(("list", 2), ("set", 1))), (3, steps(("list", 2), ("set", 2), ("list", 1))), (4, steps(("list", 2), ("set", 2), ("list", 2)))]
    rows = spark.createDataFrame([("c", *a) for a in atoms], "k string, atom_index int, steps array<struct<kind:string,child:int>>")
    got = order.constraints(rows, ["k"]).orderBy("constraint_index").collect()
    assert [(r.before_gt_atom_index, r.after_gt_atom_index) for r in got] == [(3, 4), (1, 2), (1, 3), (1, 4)]
    places = spark.createDataFrame([("c", 1, 2, 0.9), ("c", 2, 2, 0.9), ("c", 3, 1, 0.9)], "k string, gt_atom_index int, place int, match_score double")
    judged = order.status(order.constraints(rows, ["k"]), places, ["k"])
    assert sorted(r.status for r in judged.collect()) == ["respected", "unmatched", "unmatched", "violated"]
    row = order.summary(judged, ["k"], spark.createDataFrame([("c",), ("none",)], "k string")).orderBy("k").collect()
    assert (row[0].order_score, row[0].order_coverage, row[0].strict_order_score) == (0.5, 0.5, 0.25) and row[1].strict_order_score == 1.0


def test_thresholds_with_a_plateau_and_one_class(spark):
    rows = spark.createDataFrame([(0.2, False), (0.8, True)], "cosine double, expected_match boolean")
    assert metrics.recommended(metrics.sweep(rows, 0.1)).first().recommended_threshold == 0.55
    only = metrics.sweep(spark.createDataFrame([(0.3, True)], rows.schema), 0.1).orderBy("threshold").collect()
    assert len(only) == 11 and only[3].equivalent_recall == 1.0 and only[4].equivalent_recall == 0.0 and only[0].unrelated_recall == 0.0
    with pytest.raises(ValueError):
        metrics.sweep(rows, 0)


def test_calibration_of_each_language(spark):
    rows = spark.createDataFrame([(lang, f"s_{label}", label, "c", "s", "one two", texts) for lang in ("en", "fr") for label, texts in (("equivalent", ["one two", "one two three"]), ("unrelated", ["xyz"]))], "language string, id string, label string, concept string, source_statement_id string, text_a string, text_b_variants array<string>")
    result = calibration.calibrate(rows, hashing_encoder())
    summary = {(r.language, r.label): r for r in result["summary"].collect()}
    assert summary["fr", "equivalent"]["count"] == 2 and summary["en", "overall"]["count"] == 3 and summary["en", "overall"]["mean"] is None and summary["en", "overall"].accuracy_at_threshold == 1.0
    assert result["sweep"].count() == 202 and result["scores"].count() == 6


def test_seeded_pairs_keep_what_is_known(spark):
    rows = spark.createDataFrame([(f"a/pc1_q{i}.yaml", "en", "1", "1", "1", f, "p", f"text {i} {f}", i) for i in range(3) for f in sampling.FIELDS] + [("a/pc1_q0.yaml", "en", "1", "1", "1", "outcomes", "p", " TEXT  0 outcomes", 9)], "source_file string, language string, pc string, exercise string, subquestion_index string, field string, atom_path string, text string, pos long")
    first = calibration.seed_pairs(rows, 4)
    picked = first["selected_statements"].orderBy("pick").collect()
    assert [r.field for r in picked] == sampling.FIELDS[:4] and [r.id for r in picked] == [f"sem_000{i}" for i in range(1, 5)]
    assert first["pair_templates"].count() == 12
    kept = spark.createDataFrame([("sem_0002", "mine", "outcomes", "a/pc1_q2.yaml", "1", "p", "text 2 outcomes")], "id string, concept string, field string, source_file string, subquestion_index string, atom_path string, text string")
    old = spark.createDataFrame([("sem_0002", "unrelated", ["v"])], "source_statement_id string, label string, text_b_variants array<string>")
    again = calibration.seed_pairs(rows, 3, kept, old)
    assert [(r.id, r.concept) for r in again["selected_statements"].orderBy("pick").collect()][0] == ("sem_0002", "mine")
    assert {r.id for r in again["selected_statements"].collect()} == {"sem_0001", "sem_0002", "sem_0003"}
    assert [r.text_b_variants for r in again["pair_templates"].where("id = 'sem_0002_unrelated'").collect()] == [["v"]]
    with pytest.raises(ValueError):
        calibration.seed_pairs(rows, 99)


def test_numbers_without_one_task(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v long")
    got = {r.v: r.number for r in numbered(rows, "v", parts=5).collect()}
    assert got == {v: v + 1 for v in range(101)}


def test_inventory_writes_sets_as_tuples(spark):
    rows = inventory.inventory(exercise(spark, source_file="a.yaml", language="en", pc="1", exercise="1")).orderBy("pos").collect()
    assert [(r.subquestion_index, r.field, r.atom_path) for r in rows[:4]] == [("", "assumption_global", "global"), ("", "assumption_global", "global"), ("1", "assumptions", "subquestions[1].assumptions"), ("1", "preconditions", "subquestions[1].atoms/list[1]")]
    assert rows[-1].atom_path == "subquestions[2].atoms/tuple[2]"


def test_selection(spark):
    key = "call1_model string, language string, variation string, pc string, exercise string, strategy_abbreviation string"
    answer = "Question 1:\nq\n\nAnswer:\nThe alpha beta formula $x=1$\n"
    responses = spark.createDataFrame([("m", "en", "b", "1", "pc1_q1", "seq", answer), ("m", "en", "b", "1", "pc1_q2", "seq", answer)], f"{key}, text string")
    good = "subquestions: [{atoms: [{preconditions: [], arguments: [alpha beta], outcomes: ['x=1']}]}]"
    texts = {"b": good, "a": good, "c": "subquestions: []", "d": ": ["}
    candidates = spark.createDataFrame([("m", "en", "b", "1", "pc1_q1", "seq", n, n, t) for n, t in texts.items()], f"{key}, call2_model string, path string, text string")
    result = selecting.select(responses, candidates)
    rows = {r.exercise: r for r in result["selections"].collect()}
    assert (rows["pc1_q1"].selected_call2_model, rows["pc1_q1"].selection_margin, rows["pc1_q1"].needs_review) == ("a", 0.0, True)
    assert rows["pc1_q2"].status == "all_candidates_failed" and rows["pc1_q1"].target == "m/en/b/pc1_q1_seq.yaml"
    assert {r.call2_model: r.valid for r in result["candidates"].collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert result["summary"].first().selection_coverage == 0.5
    assert [r.text for r in selecting.chosen_texts(result["selections"], candidates).collect()] == [good]


PROMPTS = {"en": {"common_header": "Context: $context\n$global_assumptions", "strategies": {s: f"{s} $accumulated_questions $ground_truth_history $self_history Q$current_question_number" for s in ("strictly_sequential", "self_history", "ground_truth_forcing", "prompt_accumulation")}, "per_question_conversion": "convert $source_answer", "repair": "repair $raw_response: $error_message"}}


def test_generation_goes_on_from_its_own_answers(spark):
    rows = trees.parsed(spark.createDataFrame([("1", "1", "en", GT)], "pc string, q string, language string, text string"), answers=True)
    jobs = conversion.answer_jobs(rows, ["baseline"], ["self_history", "ground_truth_forcing"], ["big/model"])

    def echo(model, prompt):
        if "ground_truth_forcing" in prompt and "Q2" in prompt:
            raise RuntimeError("down")
        return f"<{prompt.splitlines()[-1]}>" if "Q2" in prompt else "first"

    good, failed = conversion.run_answers(jobs, generate.retried(echo, 2), PROMPTS)
    text = good.first().text
    assert text.startswith("Exercise: pc1_q1\nModel: big/model\nVariation: baseline\nPrompt type: self_history\n\nQuestion 1:\nq1\n\nAnswer:\nfirst\n\nQuestion 2:") and text.endswith("\n")
    assert failed.count() == 1 and failed.first().error == "down"
    assert {r.target for r in jobs.collect()} == {"plain_text/big-model/en/baseline/pc1_q1_self.txt", "plain_text/big-model/en/baseline/pc1_q1_gtf.txt"}
    assert conversion.without_done(jobs, jobs.limit(1)).count() == 1


def test_conversion_asks_for_repairs(spark):
    answers = spark.createDataFrame([("1", "1", "en", "Question 1:\na\n\nQuestion 2:\nb\n"), ("1", "2", "en", "Question 1:\nbad\n")], "pc string, q string, language string, text string")

    def reply(model, prompt):
        if "bad" in prompt:
            return "nothing"
        return "```yaml\natoms: [{arguments: [x]}, {preconditions: [], outcomes: []}]\n```" if prompt.startswith("repair") else "atoms: {}"

    good, failed = conversion.run_conversions(conversion.conversion_jobs(answers, ["m"]), reply, PROMPTS, 1)
    data = trees.load_tagged(good.first().text)
    assert len(data["subquestions"]) == 2 and data["subquestions"][0]["atoms"] == [{"arguments": ["x"], "preconditions": [], "outcomes": []}]
    assert failed.first().error.startswith("Question block 1/1 failed: Top-level YAML value must be a mapping")
    assert generate.direct_yaml(["atoms: []", "x"])[0] is None and generate.direct_yaml(["atoms: []"])[1] is None


def test_arrivals_are_taken_up_once(spark, tmp_path):
    gt = exercise(spark, language="en", exercise="pc1_q1")
    source, out = tmp_path / "in", str(tmp_path / "out")
    for model in ("m", "n"):
        (source / model / "en/baseline").mkdir(parents=True)
        (source / model / "en/baseline/pc1_q1_seq.yaml").write_text(GT)
        incremental.evaluate_arrivals(spark, str(source), gt, hashing_encoder(), out, str(tmp_path / "at"), ("summary",)).awaitTermination()
    rows = spark.read.parquet(f"{out}/summary").collect()
    assert sorted((r.call1_model, r.batch) for r in rows) == [("m", 0), ("n", 1)]


def test_every_prompt_is_sent_once(spark, tmp_path):
    """The tables of good and failed jobs are both used, but the generator is called once for each prompt."""
    from stepgauge.plans import conversion

    log = str(tmp_path / "calls")

    def say(model, prompt):
        with open(log, "a") as file:
            file.write(prompt + "\n")
        if "two" in prompt:
            raise RuntimeError("no")
        return "atoms: [{preconditions: [], arguments: [a], outcomes: []}]"

    prompts = {"en": {"common_header": "p", "strategies": {"strictly_sequential": "$current_question"}, "per_question_conversion": "convert $source_answer", "repair": "repair $raw_response"}}
    sub = "array<struct<question:string,assumptions:array<string>,answer:string>>"
    rows = spark.createDataFrame([(q, "1", "en", "", [], [(q, [], None)]) for q in ("one", "two", "three")], f"pc string, q string, language string, context string, assumption_global array<string>, subquestions {sub}")
    jobs = conversion.answer_jobs(rows, ["v"], ["strictly_sequential"], ["m"], modes=["plain_text", "yaml"])
    good, failed = conversion.run_answers(jobs, say, prompts)
    assert (good.count(), failed.count(), good.count()) == (4, 2, 4)
    assert sorted(open(log).read().split()) == sorted(["p", "p", "one", "one", "p", "p", "two", "two", "p", "p", "three", "three"])
    todo = spark.createDataFrame([(1, "en", "m", ["x"]), (2, "en", "m", ["two"])], "id int, language string, model string, blocks array<string>")
    open(log, "w").close()
    good, failed = conversion.run_conversions(todo, say, prompts)
    assert (good.count(), failed.count(), good.count()) == (1, 1, 1)
    assert len(open(log).read().splitlines()) == 2


def test_generate_skips_what_is_there(spark, tmp_path):
    """The command line against a local service: both output modes, counters, and a second run that asks for nothing."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from stepgauge import cli
    from stepgauge.sources import trees

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            body = json.dumps({"response": "atoms: [{preconditions: [], arguments: [a], outcomes: []}]"}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    inputs = tmp_path / "in" / "en"
    inputs.mkdir(parents=True)
    (inputs / "pc1_q2.yaml").write_text("context: c\nassumption_global: []\nsubquestions: [{question: Why, assumptions: []}, {question: How, assumptions: []}]\n")
    settings = {
        "input": {"root_directory": str(tmp_path / "in")}, "models": [{"id": "a/b"}], "output_modes": ["plain_text", "yaml"],
        "prompts": {"languages": {"en": {"common_header": "h", "strategies": {"strictly_sequential": "$current_question", "self_history": "$self_history"}, }}},
        "output": {"root_directory": str(tmp_path / "out"), "filename_template": "pc{pc}_q{exercise}_{prompt_type_abbrev}{suffix}"},
    }
    settings["input"]["filters"] = {"prompt_types": ["strictly_sequential", "self_history"]}
    (tmp_path / "c.yaml").write_text(trees.dumped(settings))
    run = lambda: cli.main(["generate", "--config", str(tmp_path / "c.yaml"), "--endpoint", f"http://127.0.0.1:{server.server_port}"])
    assert run() == 0 and len(asked) == 8 and {x["model"] for x in asked} == {"a/b"}
    out = tmp_path / "out"
    assert sorted(str(p.relative_to(out)) for p in out.rglob("pc*")) == sorted(f"{m}/a-b/en/baseline/pc1_q2_{s}{x}" for m, x in (("plain_text", ".txt"), ("yaml", ".yaml")) for s in ("seq", "self"))
    assert len(trees.load_tagged((out / "yaml/a-b/en/baseline/pc1_q2_seq.yaml").read_text())["subquestions"]) == 2
    (out / "yaml/a-b/en/baseline/pc1_q2_seq.yaml").unlink()
    assert run() == 0 and len(asked) == 10
    assert run() == 0 and len(asked) == 10
    server.shutdown()
