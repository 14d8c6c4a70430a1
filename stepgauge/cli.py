"""The command line: python -m stepgauge.cli COMMAND ...

Each command reads and writes folders; ``--help`` tells its options.  Encoder,
judge and generators are hashed stand-ins unless an endpoint is given.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgauge.functions.vectors import Encoder, hashing_encoder
from stepgauge.functions.text import path_safe
from stepgauge.operators import generate, judge
from stepgauge.plans import calibration, conversion, evaluation, inventory, selecting
from stepgauge.sources import config, files, proofs, sinks, trees
from stepgauge.sources.config import chosen, lookup, names
from stepgauge.sources.scratch import kept


def session() -> SparkSession:
    return SparkSession.builder.appName("stepgauge").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def encoder(a: argparse.Namespace) -> Encoder:
    """The encoder that --encoder names as module:callable, called without arguments; else the hashed stand-in."""
    if not a.encoder:
        return hashing_encoder()
    module, _, name = a.encoder.partition(":")
    return getattr(importlib.import_module(module), name)()


def run_import(spark: SparkSession, a: argparse.Namespace) -> int:
    print(sinks.export(files.downloaded_tex(spark, a.source), a.destination))
    return 0


def run_parse(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = files.annotated_tex(spark, a.input)
    print(sinks.export(rows.select("target", proofs.as_yaml().alias("yaml")), a.output, text="yaml"))
    return 0


def run_extract(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = files.inventory_files(spark, a.input).where(config.accepts(F.col("language"), a.language or []))
    sinks.write_by_language(inventory.inventory(trees.parsed(rows)), a.output)
    return 0


def run_seed(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.reselect and not a.overwrite:
        raise SystemExit("--reselect needs --overwrite")
    if a.concept_count < 1:
        raise SystemExit("--concept-count must be at least 1")
    for language in a.language:
        rows = files.statement_csv(spark, f"{a.input_root}/language={language}").withColumn("language", F.lit(language))
        made = calibration.seed_pairs(rows, a.concept_count, reselect=a.reselect)
        data = {"metadata": {"language": language, "labels": list(calibration.sampling.LABELS), "concept_count": a.concept_count, "variants_per_label": calibration.sampling.VARIANTS}}
        data |= {n: [r.asDict(recursive=True) for r in made[n].orderBy(*(["pick"] if n == "selected_statements" else ["id"])).toLocalIterator()] for n in ("selected_statements", "pair_templates")}
        if not sinks.write_yaml(f"{a.output_root}/{language}/formulation_pairs.yaml", data, a.overwrite):
            print(f"{language}: left as it is")
    return 0


def pair_templates(spark: SparkSession, root: str) -> DataFrame:
    rows = []
    for f in files.pair_files(spark, root).collect():  # one file a language
        data = trees.load_tagged(f.text)
        own = lookup(data, "metadata.language")
        sources = [str(s.get("source_file", "")) for s in data.get("selected_statements", [])]
        rows += [(own, sources, f.folder, t["id"], t["label"], t["concept"], t["source_statement_id"], t["text_a"], t["text_b_variants"]) for t in data["pair_templates"]]
    out = spark.createDataFrame(rows, "own string, sources array<string>, folder string, id string, label string, concept string, source_statement_id string, text_a string, text_b_variants array<string>")
    return out.withColumn("language", files.pairs_language(F.col("own"), F.col("sources"), F.col("folder"))).drop("own", "sources", "folder")


def run_pairs(spark: SparkSession, a: argparse.Namespace) -> int:
    result = calibration.calibrate(pair_templates(spark, a.input), encoder(a), a.threshold, a.threshold_step)
    for name, rows in result.items():
        sinks.write_csv(rows, f"{a.output_dir}/formulation_pair_{name}.csv", rows.columns, 1)
    return 0


def run_matrix(spark: SparkSession, a: argparse.Namespace) -> int:
    gt, predictions = (trees.parsed(r) for r in (files.ground_truth(spark, a.ground_truth), files.predictions(spark, a.predictions)))
    for name, rows in evaluation.atom_matrices(gt, predictions, encoder(a), a.threshold).items():
        sinks.write_csv(rows, f"{a.output_dir}/{name}.csv", rows.columns)
    return 0


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    s = config.load(a.config) if a.config else {}
    root = chosen(a.output, s, "output.root_directory", "outputs/evaluation")
    predictions = files.predictions(spark, chosen(a.predictions, s, "input.predictions"))
    judged = a.judge_endpoint is not None
    if not lookup(s, "output.overwrite_existing", True):
        predictions = predictions.join(sinks.finished_groups(spark, root, judged), ["language", "variation"], "left_anti")
    gt = trees.parsed(files.ground_truth(spark, chosen(a.ground_truth, s, "input.ground_truth")))
    limit = config.by_language(F.col("language"), lookup(s, "embedding.thresholds"), lookup(s, "embedding.threshold", config.MATCH_THRESHOLD), a.threshold)
    second = None
    if judged:
        call = generate.http_generator(a.judge_endpoint, a.judge_timeout, a.judge_temperature)
        second = lambda prompt, model=a.judge_model: call(model, prompt)
    known = None
    if a.judge_cache:
        at = spark._jvm.org.apache.hadoop.fs.Path(a.judge_cache)
        known = spark.read.schema(judge.DECISION).parquet(a.judge_cache) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    band = config.judge_band(s, F.col("language"), a.judge_low_threshold, a.judge_high_threshold)
    result = evaluation.evaluate(trees.parsed(predictions), gt, encoder(a), limit, {k: names(s, f"expected.{k}") for k in ("models", "languages", "variations", "strategies")}, second, band, str(lookup(s, "prompts.judge", "")), a.judge_model, known)
    keys = ["language", "variation", "call1_model"]
    result["by_model"] = evaluation.with_coverage(result["by_model"], result["coverage"], keys)
    result["by_model_strategy"] = evaluation.with_coverage(result["by_model_strategy"], result["coverage"], [*keys, "strategy"])
    if a.judge_cache and judged:
        result["decisions"].where("not cache_hit").drop("cache_hit").write.mode("append").parquet(a.judge_cache)
    result = {name: kept(rows, name) for name, rows in result.items() if name != "decisions"}  # each group's reports are parts of these
    for g in result["summary"].select("language", "variation").distinct().collect():
        print(sinks.write_group(result, root, g.language, g.variation, judged))
    return 0 if result["summary"].where("status <> 'ok'").isEmpty() else 1


def run_select(spark: SparkSession, a: argparse.Namespace) -> int:
    s = config.load(a.config)
    wanted = lambda name: names(s, f"filters.{name}")
    answers = files.answers(spark, lookup(s, "input.call1_root"), wanted("call1_models"), wanted("languages"), wanted("variations"), wanted("strategies"))
    candidates = files.candidates(spark, lookup(s, "input.call2_root"), wanted("call2_models"))
    result = selecting.select(answers, candidates, config.weights(s), lookup(s, "ranking.tie_margin", config.TIE_MARGIN))
    root = lookup(s, "output.root_directory")
    known = result["selections"].select("target").where(F.lit(bool(lookup(s, "output.synchronize_outputs", False))))
    count = sinks.synchronized(selecting.chosen_texts(result["selections"], candidates), root, known, lookup(s, "output.overwrite_existing", False))
    summary = result["summary"].first().asDict() | count
    rows = [r.asDict() for r in result["selections"].orderBy("target").toLocalIterator()]
    sinks.write_yaml(f"{root}/{lookup(s, 'output.report_file', 'selection_report.yaml')}", {"summary": summary, "selections": rows})
    return 0


def run_generate(spark: SparkSession, a: argparse.Namespace) -> int:
    s = config.load(a.config)
    config.check_generation(s)
    filters = lambda name: names(s, f"input.filters.{name}")
    inputs = trees.parsed(files.exercises(spark, lookup(s, "input.root_directory"), filters("languages")), answers=True)
    models = [str(m.get("id") or m.get("name")) for m in config.enabled_models(s)]
    templates = [str(lookup(s, f"output.{k}_template", d)) for k, d in (("directory", "{mode}/{model}/{language}/{variation}"), ("filename", "pc{pc}_q{exercise}{suffix}"))]
    every = kept(conversion.answer_jobs(inputs, filters("variations") or ["baseline"], filters("prompt_types") or list(generate_strategies()), models, *templates, names(s, "output_modes")), "jobs")
    root = lookup(s, "output.root_directory", "outputs/call1")
    there = sinks.existing(spark, root) if not lookup(s, "output.overwrite_existing", False) else spark.createDataFrame([], "target string")
    there = kept(every.select("target").join(there, "target", "left_semi"), "there")
    rows = conversion.without_done(every, there)
    call = generate.retried(generate.http_generator(a.endpoint, a.timeout), lookup(s, "execution.max_retries", 1), lookup(s, "execution.retry_delay_seconds", 2))
    good, failed = conversion.run_answers(rows, call, lookup(s, "prompts.languages"))
    keys = ["pc", "q", "model", "language", "variation", "strategy", "mode"]
    target = every.select(*keys, "target")
    sinks.export(good.join(target, keys), root)
    failed = failed.join(target, keys)
    count = conversion.counted(every, there, failed)
    wrong = [r.asDict() for r in failed.toLocalIterator()]
    for mode in names(s, "output_modes") or ["plain_text"]:
        own = [w for w in wrong if w["mode"] == mode]
        sinks.write_error_report(f"{root}/{mode}/error_files.yaml", count["by_mode"].get(mode, {}), own)
    print({k: count[k] for k in ("jobs", "written", "skipped", "failed")})
    return 1 if wrong else 0


def generate_strategies() -> list[str]:
    from stepgauge.functions.text import STRATEGIES

    return list(STRATEGIES)


def run_convert(spark: SparkSession, a: argparse.Namespace) -> int:
    s = config.load(a.config)
    config.check_conversion(s)
    wanted = lambda name: names(s, f"input.filters.{name}")
    answers = files.answers(spark, lookup(s, "input.root_directory"), wanted("models"), wanted("languages"), wanted("variations"), wanted("prompt_types"))
    rows = conversion.conversion_jobs(answers.drop("path"), [str(m.get("id") or m.get("name")) for m in config.enabled_models(s)])
    path = "{call1_model}/{call2_model}/{language}/{variation}/{exercise}_{strategy_abbreviation}.yaml"
    every = kept(sinks.target(path, rows, call2_model=path_safe(F.col("model"))).withColumn("mode", F.lit("conversion")), "jobs")
    root = lookup(s, "output.root_directory", "outputs/call2")
    there = sinks.existing(spark, root) if not lookup(s, "output.overwrite_existing", False) else spark.createDataFrame([], "target string")
    there = kept(every.select("target").join(there, "target", "left_semi"), "there")
    todo = conversion.without_done(every, there)
    good, failed = conversion.run_conversions(todo, generate.http_generator(a.endpoint, a.timeout, empty_is_error=False), lookup(s, "prompts.languages"), lookup(s, "generation.repair_attempts", 2))
    sinks.export(good, root)
    count = conversion.counted(every, there, failed)
    wrong = [r.asDict() for r in failed.drop("text").toLocalIterator()]
    sinks.write_error_report(f"{root}/error_files.yaml", {k: count[k] for k in ("jobs", "written", "skipped", "failed")}, wrong)
    print({k: count[k] for k in ("jobs", "written", "skipped", "failed")})
    return 1 if wrong else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stepgauge", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for flags, kind in options:
            sub.add_argument(*flags.split(), **kind)

    need, many = {"required": True}, {"action": "append"}
    own_encoder = ("--encoder", {"help": "module:callable that gives an encoder; without it a hashed stand-in"})
    command("import", run_import, ("--source", need), ("--destination", {"default": "data/raw_tex"}))
    command("parse", run_parse, ("-i --input", need), ("-o --output", need))
    command("extract", run_extract, ("--input", need), ("--output", need), ("--language", many))
    command("seed", run_seed, ("--input-root", need), ("--output-root", need), ("--language", many | need), ("--concept-count", {"type": int, "default": 12}), ("--overwrite", {"action": "store_true"}), ("--reselect", {"action": "store_true"}))
    command("pairs", run_pairs, ("--input", need), ("--output-dir", need), ("--threshold", {"type": float}), ("--threshold-step", {"type": float, "default": 0.01}), own_encoder)
    command("matrix", run_matrix, ("--ground-truth", need), ("--predictions", need), ("--output-dir", need), ("--threshold", {"type": float, "default": config.MATRIX_THRESHOLD}), own_encoder)
    number = {"type": float}
    command(
        "evaluate", run_evaluate, ("--config", {}), ("--predictions", {}), ("--ground-truth", {}), ("--output", {}), ("--threshold", number), ("--judge-model", {"default": "judge"}), ("--judge-endpoint", {}),
        ("--judge-timeout", {"type": float, "default": 120}), ("--judge-temperature", {"type": float, "default": 0.0}), ("--judge-low-threshold", number), ("--judge-high-threshold", number), ("--judge-cache", {}), own_encoder,
    )
    command("select", run_select, ("--config", need))
    for name, run in (("generate", run_generate), ("convert", run_convert)):
        command(name, run, ("--config", need), ("--endpoint", need), ("--timeout", {"type": float, "default": 600}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())
