"""Queries of scans, writers, parsers, validators and generated answers.

They join the catalogue's: whole tables are written as the files that a scan
expects, by the library's own writers, and read again; generators, judges and
encoders are functions whose answers SQL can tell.  The SQL above each query is
its oracle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgauge.functions import text as T
from stepgauge.functions.rewrite import folded
from stepgauge.operators import generate, judge, sampling
from stepgauge.plans import conversion, evaluation, selecting
from stepgauge.plans.catalogue import _ASKED, _CLEAN, _FLAT, _TRIM, asked, exercises, query, table
from stepgauge.schemas import STATEMENT_COLUMNS
from stepgauge.sources import config, files, sinks, trees
from stepgauge.sources.scratch import kept, shared_folder


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def joined(*parts: Column | str | int) -> Column:
    """Columns and texts (marked by F.lit) one after the other, as text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def split_lines(c: str = "text") -> Column:
    return F.split(c, "\n")


def c(name: str) -> Column:
    return F.col(name)


# -- scans of trees of files

@query("""SELECT language || '/pc' || page_id || '_q' || (page_id % 3 + 1) || '.tex' AS target, sha256(html) AS text FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'en' ELSE 'fr' END AS language FROM pages)""")
def scan_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercises among other files are found, copied under their new names, and read again."""
    root, to, pages = folder(spark, "raw"), folder(spark, "copied"), table(spark, sf_dir, "pages")
    language = F.when(c("page_id") % 2 == 0, "en").otherwise("fr")
    rows = pages.select(joined(c("page_id") % 7, "/pc", c("page_id"), "_q", c("page_id") % 3 + 1, "_", language, ".tex").alias("target"), c("html").alias("text"))
    sinks.export(rows.unionByName(pages.where("page_id % 5 = 0").select(joined("pc", c("page_id"), "_old.tex").alias("target"), c("html").alias("text"))), root)
    sinks.export(files.downloaded_tex(spark, root), to)
    return files.texts(spark, to, "*.tex").select(c("path").alias("target"), F.sha2("text", 256).alias("text"))


@query("SELECT lang || '/' || (doc_id % 9) || '/d' || doc_id || '.yaml' AS target, sha256(text) AS text FROM documents")
def scan_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated files with the place that their YAML goes to."""
    root = folder(spark, "annotated")
    sinks.export(table(spark, sf_dir, "documents").select(joined(c("lang"), "/", c("doc_id") % 9, "/d", c("doc_id"), ".tex").alias("target"), "text"), root)
    return files.annotated_tex(spark, root).select("target", F.sha2("text", 256).alias("text"))


@query(f"""WITH {_ASKED}, s AS (SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS questions, sum(len(string_split(answer, chr(10)))) AS lines FROM q GROUP BY conv_id)
SELECT CASE conv_id % 3 WHEN 0 THEN 'en' ELSE 'unknown' END AS language, 'pc' || conv_id || '_q1' AS exercise, CAST(conv_id AS VARCHAR) AS pc, '1' AS q, 'case ' || conv_id AS context, n AS subquestions, sha256(questions) AS questions, CAST(lines AS BIGINT) AS arguments FROM s WHERE conv_id % 3 <> 1""")
def scan_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercise files by language, loaded and taken apart; those without a folder have no language."""
    none, root = F.expr("cast(array() as array<string>)"), folder(spark, "exercises")
    atom = F.struct(none.alias("preconditions"), split_lines("answer").alias("arguments"), F.array("answer").alias("outcomes"))
    sub = F.struct("turn", F.struct(c("text").alias("question"), none.alias("assumptions"), F.array(atom).alias("atoms")).alias("s"))
    rows = asked(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(sub)), lambda x: x["s"]).alias("subs"))
    place = F.when(c("conv_id") % 3 == 0, "en/deep/").when(c("conv_id") % 3 == 1, "fr/").otherwise("")
    text = F.to_json(F.struct(joined("case ", c("conv_id")).alias("context"), none.alias("assumption_global"), c("subs").alias("subquestions")))
    sinks.export(rows.select(joined(place, "pc", c("conv_id"), "_q1.yaml").alias("target"), text.alias("text")), root)
    found = trees.parsed(files.exercises(spark, root, ["en", "unknown"]))
    lines = F.aggregate("subquestions", F.lit(0).cast("long"), lambda n, s: n + F.size(s["atoms"][0]["arguments"]))
    questions = F.sha2(F.array_join(F.transform("subquestions", lambda s: s["question"]), "\n"), 256)
    return found.select("language", "exercise", "pc", "q", "context", F.size("subquestions").cast("long").alias("subquestions"), questions.alias("questions"), lines.alias("arguments"))


@query("""SELECT 'plain_text' AS call1_output_mode, CASE doc_id % 3 WHEN 0 THEN 'm-0' ELSE 'm1' END AS call1_model, lang AS language, 'v' || (doc_id % 2) AS variation, 'pc' || doc_id || '_q1' AS exercise, CAST(doc_id AS VARCHAR) AS pc,
CASE doc_id % 4 WHEN 0 THEN 'self_history' WHEN 2 THEN 'prompt_accumulation' ELSE 'odd' END AS strategy, CASE doc_id % 4 WHEN 0 THEN 'seq' WHEN 2 THEN 'acc' ELSE 'odd' END AS strategy_abbreviation, sha256(CASE WHEN doc_id % 4 = 0 THEN 'Prompt type: self_history' || chr(10) ELSE '' END || text) AS text
FROM documents WHERE doc_id % 3 < 2 AND doc_id % 4 <> 1""")
def scan_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers through four filters, one of which is empty; a header's prompt type counts before the name's."""
    root, docs = folder(spark, "answers"), table(spark, sf_dir, "documents")
    model = F.when(c("doc_id") % 3 == 0, "m-0").otherwise(joined("m", c("doc_id") % 3))
    short = F.when(c("doc_id") % 4 < 2, "seq").when(c("doc_id") % 4 == 2, "acc").otherwise("odd")
    head = F.when(c("doc_id") % 4 == 0, "Prompt type: self_history\n").otherwise("")
    sinks.export(docs.select(joined("plain_text/", model, "/", c("lang"), "/v", c("doc_id") % 2, "/sub/pc", c("doc_id"), "_q1_", short, ".txt").alias("target"), F.concat(head, "text").alias("text")), root)
    rows = files.answers(spark, root, models=["m/0", "m1"], strategies=["self_history", "prompt_accumulation", "odd"])
    return rows.select("call1_output_mode", "call1_model", "language", "variation", "exercise", "pc", "strategy", "strategy_abbreviation", F.sha2("text", 256).alias("text"))


def atoms_json(arguments: Column) -> Column:
    """A conversion's text: an atom for each argument."""
    none = F.expr("cast(array() as array<string>)")
    atoms = F.transform(arguments, lambda x: F.struct(none.alias("preconditions"), F.array(x).alias("arguments"), none.alias("outcomes")))
    return F.to_json(F.struct(F.array(F.struct(atoms.alias("atoms"))).alias("subquestions")))


@query("""SELECT 'pc' || doc_id || '_q1' AS exercise, 'c' || (doc_id % 2) AS call2_model, doc_id % 3 = 0 AS failed, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS atoms FROM documents""")
def scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions of five path parts; one that isn't YAML has an error and no row less."""
    root, docs = folder(spark, "candidates"), table(spark, sf_dir, "documents")
    text = F.when(c("doc_id") % 3 == 0, "{a: [").otherwise(atoms_json(F.array("lang", "source")))
    place = lambda models: joined(models, "/", c("lang"), "/base/pc", c("doc_id"), "_q1_seq.", F.when(c("doc_id") % 2 == 0, "yaml").otherwise("yml"))
    rows = docs.select(place(joined("m/c", c("doc_id") % 2)).alias("target"), text.alias("text"))
    sinks.export(rows.unionByName(docs.where("doc_id % 5 = 0").select(place(F.lit("short")).alias("target"), text.alias("text"))), root)
    read = trees.parsed(files.candidates(spark, root))
    return read.select("exercise", "call2_model", c("error").isNotNull().alias("failed"), F.coalesce(F.size(F.get("subquestions", 0)["atoms"]), F.lit(0)).alias("atoms"))


@query("""SELECT 'm/' || lang || '/base/deep/pc' || doc_id || '_q1' || CASE WHEN doc_id % 2 = 0 THEN '_seq' ELSE '' END || '.yaml' AS prediction_path, lang AS language, 'pc' || doc_id || '_q1' AS exercise, CASE WHEN doc_id % 2 = 0 THEN 'seq' ELSE '' END AS strategy,
CASE WHEN doc_id % 3 > 0 THEN lang || '/pc' || doc_id || '_q1.yml' END AS gt_path FROM documents""")
def scan_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions beside files that are none, and the ground truth of their language and exercise."""
    root, truth, docs = folder(spark, "predictions"), folder(spark, "truth"), table(spark, sf_dir, "documents")
    name = joined("pc", c("doc_id"), "_q1")
    rows = docs.select(joined("m/", c("lang"), "/base/deep/", name, F.when(c("doc_id") % 2 == 0, "_seq").otherwise(""), ".yaml").alias("target"), c("lang").alias("text"))
    other = docs.where("doc_id % 7 = 0").select(joined("flat/", name, ".yaml").alias("target"), c("lang").alias("text"))
    sinks.export(rows.unionByName(other), root)
    sinks.export(docs.where("doc_id % 3 > 0").select(joined(c("lang"), "/", name, ".yml").alias("target"), c("lang").alias("text")), truth)
    found = files.predictions(spark, root).join(files.ground_truth(spark, truth).drop("text"), ["language", "exercise"], "left")
    return found.select("prediction_path", "language", "exercise", "strategy", "gt_path")


@query("""SELECT CASE doc_id % 3 WHEN 0 THEN lang || '/pc' || doc_id || '_q2.yaml' WHEN 1 THEN 'note' || doc_id || '.yml' ELSE lang || '/other' || doc_id || '.yaml' END AS source_file, CASE doc_id % 3 WHEN 1 THEN '' ELSE lang END AS language, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS pc, CASE doc_id % 3 WHEN 0 THEN '2' ELSE '' END AS exercise FROM documents""")
def scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All YAML files of both endings; what a path doesn't tell is empty."""
    root, k = folder(spark, "inventory"), c("doc_id") % 3
    path = F.when(k == 0, joined(c("lang"), "/pc", c("doc_id"), "_q2.yaml")).when(k == 1, joined("note", c("doc_id"), ".yml")).otherwise(joined(c("lang"), "/other", c("doc_id"), ".yaml"))
    docs = table(spark, sf_dir, "documents").select(path.alias("target"), c("source").alias("text"))
    sinks.export(docs.unionByName(docs.select(F.regexp_replace("target", r"\.ya?ml$", ".txt").alias("target"), "text")), root)
    return files.inventory_files(spark, root).drop("text")


@query("""SELECT lang AS language, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'g' || lang ELSE 'f' || lang END AS found, doc_id FROM documents""")
def pair_file_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair file's language: what it says, else its statements' files', else its folder; one file a language is found."""
    root, docs, k = folder(spark, "pairs"), table(spark, sf_dir, "documents"), c("doc_id") % 3
    sinks.export(docs.select("lang").distinct().select(joined("x/", c("lang"), "/formulation_pairs.yaml").alias("target"), c("lang").alias("text")), root)
    at = files.one_per(files.pair_files(spark, root), "folder", "language").select(c("folder").alias("language"))
    stated = F.when(k == 2, F.expr("cast(array() as array<string>)")).otherwise(F.array(joined("a/ground_truth/g", c("lang"), "/x.yaml"), joined("ground_truth/g", c("lang"), "/y.yaml")))
    rows = docs.join(at, docs.lang == at.language)
    return rows.select("language", "doc_id", files.pairs_language(F.when(k == 0, c("lang")), stated, joined("f", c("lang"))).alias("found"))


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 10 < 5 AND doc_id < 40)")
def settings_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file that is written, loaded, looked up; its models that are not switched off choose rows."""
    docs = table(spark, sf_dir, "documents")
    named = docs.where("doc_id < 40").groupBy("source").agg(F.min(c("doc_id") % 10).alias("n")).collect()  # names of at most 40 rows: a settings file
    settings = {"models": [{"id": r.source} | ({} if r.n < 3 else {"enabled": r.n < 5}) for r in named]}
    root = folder(spark, "settings")
    sinks.export(spark.createDataFrame([("a.yaml", trees.dumped(settings))], "target string, text string"), root)
    loaded = trees.load_tagged(files.texts(spark, root).first().text)
    models = [m["id"] for m in config.enabled_models(loaded)]
    return docs.where(config.accepts(c("source"), models)).select("doc_id", "source")


# -- writers

@query(f"SELECT lang AS language, 'd' || doc_id || '.yaml' AS source_file, CASE doc_id % 2 WHEN 0 THEN '' ELSE '1' END AS subquestion_index, sha256({_FLAT}) AS text FROM documents")
def statement_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement inventory written as CSV, a folder for each language, and read again."""
    root, docs = folder(spark, "statements"), table(spark, sf_dir, "documents")
    values = {"source_file": joined("d", c("doc_id"), ".yaml"), "language": c("lang"), "pc": F.lit("1"), "exercise": F.lit("2"), "subquestion_index": F.when(c("doc_id") % 2 == 0, "").otherwise("1"), "field": F.lit("outcomes"), "atom_path": F.lit('a "b", c'), "text": F.trim(F.regexp_replace("text", r"\s+", " "))}
    sinks.write_by_language(docs.select(*[values[n].alias(n) for n in STATEMENT_COLUMNS]), root)
    out = None
    for language in sorted(r[0] for r in docs.select("lang").distinct().collect()):  # a folder for each language
        rows = files.statement_csv(spark, f"{root}/language={language}").withColumn("language", F.lit(language))
        out = rows if out is None else out.unionByName(rows)
    return out.where("atom_path = 'a \"b\", c' and field = 'outcomes'").select("language", "source_file", "subquestion_index", F.sha2("text", 256).alias("text"))


@query("SELECT lang || '/d' || doc_id || '.txt' AS target, sha256(text) AS text FROM documents WHERE doc_id % 3 > 0")
def synchronized_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs are written; a second run leaves what is there and deletes what it has no row for."""
    root, docs = folder(spark, "selected"), table(spark, sf_dir, "documents").withColumn("target", joined(c("lang"), "/d", c("doc_id"), ".txt"))
    sinks.export(docs.select("target", "text"), root)
    sinks.synchronized(docs.where("doc_id % 3 > 0").select("target", F.lit("new").alias("text")), root, sinks.existing(spark, root), overwrite=False)
    return files.texts(spark, root).select(c("path").alias("target"), F.sha2("text", 256).alias("text"))


@query("SELECT DISTINCT lang AS language, source AS variation FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = d.lang AND e.source = d.source AND e.doc_id % 40 = 0)")
def unfinished_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose report is there are passed over."""
    root, docs = folder(spark, "reports"), table(spark, sf_dir, "documents").select("doc_id", c("lang").alias("language"), c("source").alias("variation"))
    sinks.export(docs.where("doc_id % 40 = 0").select(joined(c("language"), "/", c("variation"), "/embedding_only/evaluation_summary.csv").alias("target")).distinct().withColumn("text", F.lit("x")), root)
    return docs.select("language", "variation").distinct().join(sinks.finished_groups(spark, root, False), ["language", "variation"], "left_anti")


@query("SELECT conv_id, turn, sha256(text) AS text, len(string_split(text, chr(10))) AS n FROM conversations")
def yaml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts dumped as YAML, lines as an unordered set, and loaded again."""
    def one(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            data = trees.load_tagged(trees.dumped({"text": text, "lines": tuple(text.split("\n"))}))
            out.append({"text": data["text"], "n": len(data["lines"]) if isinstance(data["lines"], tuple) else -1})
        return pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int64())]))

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.arrow_udf(one, "text string, n long")("text").alias("y"))
    return rows.select("conv_id", "turn", F.sha2("y.text", 256).alias("text"), "y.n")


# -- annotated LaTeX

_LINE = r"regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g')"


@query(rf"SELECT doc_id, true AS tagged, false AS untagged, source || ' % x' AS behind, {_LINE} AS ahead, source || ' \% kept' AS bare, true AS comment, false AS tag_comment FROM documents")
def tag_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(split_lines()[0], F.lit(" %@ATOM "), "source", F.lit(" % x "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.has_tag(line, "ATOM").alias("tagged"), T.has_tag(line, "ATO").alias("untagged"), T.after_tag(line, "ATOM").alias("behind"), T.before_tag(line, "ATOM").alias("ahead"),
        T.without_comment(F.concat("source", F.lit(r" \% kept % gone"))).alias("bare"), T.is_plain_comment(F.concat(F.lit(" % "), "source")).alias("comment"), T.is_plain_comment(F.concat(F.lit("%@ATOM "), "source")).alias("tag_comment"),
    )


@query(rf"""WITH l AS (SELECT doc_id, source, {_LINE} AS line FROM documents)
SELECT doc_id, source || ' holds, or by taking ' || line || ' so' AS argument, 'So ' || regexp_replace(line || '!', '[.,](\$)?$', '\1') || '' AS outcome, line || 'x.' AS plain FROM l""")
def argument_outcome_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments lose conjunctions around them and the final mark; outcomes their lead, and the mark behind some openings."""
    line = F.regexp_replace(split_lines()[0], r"^\s+|\s+$", "")
    said = joined("and ", c("source"), " holds, (or by taking ", line, " so. et")
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_argument(said).alias("argument"), T.clean_outcome(joined("which directly gives So ", line, "!,")).alias("outcome"), T.clean_outcome(joined(line, "x.")).alias("plain"))


@query(rf"WITH l AS (SELECT doc_id, source, {_LINE} AS line FROM documents) SELECT doc_id, {_CLEAN.format("line || ' ' || source || ' q'")} AS marked, {_CLEAN.format("'q ' || line || ' q'")} AS bare FROM l")
def question_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question behind its tag, with the text of its assumptions; without a tag all of the zone."""
    line = split_lines()[0]
    zone = joined("junk %@QUESTION ", line, " %@ASSUMPTION ", c("source"), " %@ASSUMPTION_END q %@QUESTION_END tail")
    return table(spark, sf_dir, "documents").select("doc_id", T.question_text(zone).alias("marked"), T.question_text(joined("q ", line, " q")).alias("bare"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars + 0.5 WHEN 1 THEN -n_chars * 100.0 END::DOUBLE AS strength FROM documents")
def strength_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", T.strength(F.when(k == 0, joined(" ", c("n_chars"), ".5 of it")).when(k == 1, joined("-", c("n_chars"), "e2x")).otherwise("high 5")).alias("strength"))


@query(r"SELECT doc_id, ['b=' || n_chars, 'a_' || doc_id, 'c' || lower(lang), 'd'] AS formulas FROM documents")
def formulas_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas between each kind of mark, bare; the look-around keeps $$..$$ and $..$ apart."""
    said = joined("x $A_", c("doc_id"), "$ y $$ b \\, = ", c("n_chars"), "$$ \\[ C\\quad ", c("lang"), " \\] and \\(d\\) $ $")
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(T.source_formulas(said), T.bare_formula).alias("formulas"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10)), ' | ') AS shown FROM documents")
def displayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.display(split_lines()).alias("shown"))


@query(f"SELECT doc_id, 'd' || doc_id AS exercise, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '1' END AS subquestion, lang AS field, source AS path, lower({_FLAT}) AS text FROM documents")
def statement_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.statement_key(joined("a/b/d", c("doc_id"), ".yaml"), F.when(c("doc_id") % 2 == 1, F.lit(1)), c("lang"), c("source"), c("text"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("k")).select("doc_id", "k.*")


# -- validation, selection

_PAYLOADS = [  # YAML of one question, and its first fault
    ("subquestions: [{atoms: [{preconditions: [], arguments: [x], outcomes: []}]}]", None),
    ("name: x\nsubquestions: []", "Converted YAML looks like a generic benchmark configuration; forbidden top-level key(s): name."),
    ("a: 1", "Converted YAML must contain a top-level 'subquestions' key."),
    ("subquestions: 5", "Top-level 'subquestions' value must be a list."),
    ("subquestions: []", "Expected exactly 1 top-level subquestion item(s)"),
    ("subquestions: [{atoms: [{preconditions: [], arguments: [x]}]}]", "subquestions[1].atoms[1] is missing atom key(s): outcomes."),
    ("subquestions: [{atoms: [[{preconditions: [], arguments: [], outcomes: []}]]}]", "subquestions[1].atoms[1][1].arguments must contain at least one argument."),
    ("subquestions: [{atoms: [{preconditions: [], arguments: [x], outcomes: [], b: 1, a: 2}]}]", "subquestions[1].atoms[1] has unexpected key(s): a"),
    ("subquestions: [{atoms: !!python/tuple [{preconditions: [], arguments: [x]}, {outcomes: [z]}]}]", None),
    ("[1]", "Top-level YAML value must be a mapping."),
]


def _first_faults(rows: list[tuple[str, str | None]]) -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "CASE doc_id % " + str(len(rows)) + "".join(f" WHEN {k} THEN {quoted(fault)}" for k, (_, fault) in enumerate(rows)) + " END"


def _payload(rows: list[tuple[str, str | None]]) -> Column:
    return F.get(F.array(*[F.lit(text) for text, _ in rows]), (c("doc_id") % len(rows)).cast("int"))


@query(f"SELECT doc_id, {_first_faults(_PAYLOADS)} AS error FROM documents")
def validate_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversions, repaired and checked: the first fault counts (up to its first comma)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", _payload(_PAYLOADS).alias("text"), F.lit(1).alias("expected"))
    return trees.parsed(rows, "text", "expected", check=True).select("doc_id", F.split("error", ",")[0].alias("error"))


_SINGLE = [
    ("```yaml\natoms: [{preconditions: [], arguments: [x], outcomes: []}]\n```", None),
    ("b: 1", "Single-question conversion must contain an 'atoms' key."),
    ("subquestions: {}", "Top-level 'subquestions' value must be a list."),
    ("subquestions: [1]", "subquestions[1] must be a mapping."),
    ("subquestions: [{}]", "subquestions[1] must contain an 'atoms' key."),
    ("<think>no: [</think>subquestions: [{atoms: []}]", None),
    ("atoms: [{preconditions: [], arguments: [5], outcomes: []}]", "atoms[1].arguments[1] must be a string."),
    ("atoms: word", "atoms must be an atom mapping"),
]


@query(f"SELECT doc_id, {_first_faults(_SINGLE)} AS error FROM documents")
def validate_single_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to one question, out of their fence and checked."""
    one = lambda texts: pa.array([generate.read_single(t)[1] for t in texts.to_pylist()], pa.string())
    return table(spark, sf_dir, "documents").select("doc_id", F.split(F.arrow_udf(one, "string")(_payload(_SINGLE)), ",")[0].alias("error"))


@query("SELECT 'm/' || lang || '/base/pc' || doc_id || '_q1_seq.yaml' AS target, CASE WHEN doc_id % 4 = 0 THEN 'all_candidates_failed' ELSE 'selected' END AS status, CASE WHEN doc_id % 4 > 0 THEN 'c0' END AS selected_call2_model FROM documents")
def selection_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with a true conversion (three in four), an invented and a broken one: what is chosen."""
    docs = table(spark, sf_dir, "documents").withColumn("said", F.translate("text", "=\\\\$∫∑√≤≥→∞", ""))
    case = [F.lit("m").alias("call1_model"), c("lang").alias("language"), F.lit("base").alias("variation"), c("doc_id").cast("string").alias("pc"), F.lit("1").alias("q"), joined("pc", c("doc_id"), "_q1").alias("exercise"), F.lit("seq").alias("strategy_abbreviation")]
    responses = docs.select(*case, F.concat(c("said"), F.lit(" content")).alias("text"))
    made = lambda model, text: docs.select(*case, F.lit(model).alias("call2_model"), joined(model, "/", c("doc_id")).alias("path"), text.alias("text"), "doc_id")
    every = made("c0", atoms_json(F.array(F.concat(c("said"), F.lit(" content"))))).where("doc_id % 4 > 0")
    every = every.unionByName(made("c1", atoms_json(F.array(F.lit("zzz yyy xxx")))).where("doc_id % 4 > 0")).unionByName(made("bad", F.lit("[]")))
    return selecting.select(responses, every.drop("doc_id"))["selections"].select("target", "status", "selected_call2_model")


# -- generation

def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as exercises whose questions are the user's turns."""
    none = F.expr("cast(array() as array<string>)")
    sub = F.struct("turn", F.struct(c("text").alias("question"), none.alias("assumptions"), c("answer")).alias("s"))
    rows = asked(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(sub)), lambda x: x["s"]).alias("subquestions"))
    return rows.select(c("conv_id").cast("string").alias("pc"), F.lit("1").alias("q"), F.lit("en").alias("language"), F.lit("").alias("context"), none.alias("assumption_global"), "subquestions")


def _forgetful():
    """A generator that fails at first for each prompt, then tells how many answers it has been shown."""
    seen = set()

    def say(model: str, prompt: str) -> str:
        if prompt not in seen:
            seen.add(prompt)
            raise RuntimeError("busy")
        return f"{model}{prompt.count('Your answer:')}"

    return say


_PROMPTS = {"en": {"common_header": "${context}", "strategies": {"self_history": "${self_history}\n${current_question}", "strictly_sequential": "${current_question}"}}}


@query(f"""WITH {_ASKED}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM q), s AS (SELECT * FROM n, unnest(['self_history', 'strictly_sequential']) AS t(strategy))
SELECT CAST(conv_id AS VARCHAR) AS pc, strategy, CAST(k AS INT) AS subquestion, text AS question, 'm' || CASE strategy WHEN 'self_history' THEN k - 1 ELSE 0 END AS answer FROM s""")
def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question by question, with the own answers so far where the protocol shows them; each call is tried twice."""
    jobs = conversion.jobs(questions(spark, sf_dir), variation=["base"], strategy=["self_history", "strictly_sequential"], model=["m"])
    return generate.answers(jobs, generate.retried(_forgetful(), 2), _PROMPTS).where("error is null").select("pc", "strategy", "subquestion", "question", "answer")


@query(rf"""WITH {_ASKED}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM q)
SELECT CAST(conv_id AS VARCHAR) AS pc, sha256(regexp_replace('Exercise: pc' || conv_id || '_q1' || chr(10) || 'Model: m' || chr(10) || 'Variation: base' || chr(10) || 'Prompt type: strictly_sequential' || chr(10) || chr(10)
  || string_agg('Question ' || k || ':' || chr(10) || text || chr(10) || chr(10) || 'Answer:' || chr(10) || 'm0' || chr(10), chr(10) ORDER BY k), '\s+$', '') || chr(10)) AS text FROM n GROUP BY conv_id""")
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain text of a job's answers."""
    jobs = conversion.answer_jobs(questions(spark, sf_dir), ["base"], ["strictly_sequential"], ["m"])
    good, _ = conversion.run_answers(jobs, generate.retried(_forgetful(), 2), _PROMPTS)
    return good.select("pc", F.sha2("text", 256).alias("text"))


@query(f"""WITH {_ASKED}, s AS (SELECT conv_id, count(*) AS n FROM q GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS pc, CASE WHEN conv_id % 3 = 0 AND n > 1 THEN 'answer 2: atoms must be an atom mapping' END AS error, CASE WHEN conv_id % 3 = 0 AND n > 1 THEN 0 ELSE n END AS atoms FROM s""")
def direct_yaml_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are YAML already become one conversion, or the error of the first bad one."""
    rows = questions(spark, sf_dir).select("pc", F.posexplode("subquestions").alias("n", "s"))
    bad = (c("pc").cast("long") % 3 == 0) & (c("n") == 1)
    rows = rows.select("pc", (c("n") + 1).alias("subquestion"), F.when(bad, "atoms: 5").otherwise("```yaml\natoms: [{preconditions: [], arguments: [a], outcomes: []}]\n```").alias("answer"))
    out = sinks.direct_yaml(rows)
    return out.select("pc", F.split("error", ",")[0].alias("error"), F.coalesce(F.regexp_count("text", F.lit("arguments:")), F.lit(0)).cast("long").alias("atoms"))


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'Question block 1/2 failed: Single-question conversion must contain an ''atoms'' key.' END AS error, lang <> 'de' AS converted FROM documents""")
def repaired_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A converter whose first response is never right; asked to repair it, it succeeds but in one language."""
    def say(model: str, prompt: str) -> str:
        return "atoms: [{preconditions: [], arguments: [a], outcomes: []}]" if prompt.startswith("repair") and "task de" not in prompt else "nothing: 1"

    docs = table(spark, sf_dir, "documents")
    jobs = docs.select("doc_id", c("lang").alias("language"), F.lit("m").alias("model"), T.question_blocks(joined("Question 1:\n", c("source"), "\nQuestion 2:\nx")).alias("blocks"))
    prompts = {r[0]: {"per_question_conversion": "task ${language} ${source_answer}", "repair": "repair ${raw_response} ${error_message}"} for r in docs.select("lang").distinct().collect()}  # languages of the corpus
    good, failed = conversion.run_conversions(jobs, say, prompts)
    return good.unionByName(failed).select("doc_id", "error", c("text").isNotNull().alias("converted"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'judge_error' ELSE 'equivalent' END AS label, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, doc_id % 2 = 0 AS cache_hit FROM documents")
def judge_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a first run, errors too, are read again by a second one, which asks for the others alone."""
    def say(prompt: str) -> str:
        if int(prompt) % 5 == 0:
            raise RuntimeError("no answer")
        return "label: equivalent\nconfidence: 0.5\nreason: so"

    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("D1").alias("dimension"), F.lit("outcomes").alias("field"), c("doc_id").cast("string").alias("gt_text"), c("text").alias("model_text"))
    rows = judge.keyed(rows, "$gt_text", "judge")
    none = spark.createDataFrame([], judge.DECISION)
    known = kept(judge.decide(rows.where("doc_id % 2 = 0"), none, "$gt_text", say), "judged")
    fresh = judge.decide(rows, known, "$gt_text", say)
    both = known.withColumn("cache_hit", F.lit(True)).unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    return rows.join(both, "cache_key").select("doc_id", "label", "confidence", "cache_hit")


# -- the whole evaluation, with an encoder that tells texts apart by their length

def by_length(texts: list[str]) -> np.ndarray:
    """One of 16 directions by a text's length."""
    return np.eye(16, dtype=np.float32)[[len(t) % 16 for t in texts]]


_EVALUATED = """a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'),
p AS (SELECT g.conv_id, g.k AS gt, g.n + 1 - m.k AS model, list_transform(string_split(g.text, chr(10)), lambda x: length(x) % 16) AS gl, list_transform(string_split(m.text, chr(10)), lambda x: length(x) % 16) AS ml, length(g.text) % 16 = length(m.text) % 16 AS same FROM a g JOIN a m USING (conv_id)),
s AS (SELECT conv_id, gt, model, 'D1' AS d, list_avg(list_transform(gl, lambda x: CAST(list_contains(ml, x) AS INT))) AS score FROM p UNION ALL SELECT conv_id, gt, model, 'D3', CAST(same AS INT) FROM p),
b AS (SELECT conv_id, d, gt, max(score) AS score FROM s GROUP BY ALL), o AS (SELECT conv_id, d, avg(CAST(hit AS INT)) AS pr FROM (SELECT conv_id, d, model, bool_or(score >= 0.415) AS hit FROM s GROUP BY ALL) GROUP BY ALL),
m AS (SELECT conv_id, d, avg(round(score, 6)) AS best, avg(CAST(score >= 0.415 AS INT)) AS cover, any_value(pr) AS pr FROM b JOIN o USING (conv_id, d) GROUP BY ALL),
w AS (SELECT conv_id, d, best, cover, pr, coalesce(2 * cover * pr / nullif(cover + pr, 0), 0) AS f1 FROM m)"""


def evaluated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = exercises(spark, sf_dir)
    gt = rows.select(F.lit("en").alias("language"), joined("pc", c("conv_id"), "_q1").alias("exercise"), *[c(x) for x in rows.columns[1:]], "conv_id")
    turned = F.transform("subquestions", lambda s: s.withField("atoms", F.transform(F.reverse(s["atoms"]), lambda a, i: a.withField("atom_index", i + 1))))
    predictions = gt.select(F.lit("m").alias("call1_model"), "language", F.lit("baseline").alias("variation"), "exercise", F.lit("seq").alias("strategy"), c("exercise").alias("prediction_path"), "context", "assumption_global", turned.alias("subquestions"), "error")
    return evaluation.evaluate(predictions, gt.where("conv_id % 4 < 3").drop("conv_id"), by_length)


_MEASURES = {"mean_best_score": "best", "coverage": "cover", "precision": "pr", "f1": "f1"}


@query(f"WITH {_EVALUATED} SELECT 'pc' || c.conv_id || '_q1' AS exercise, CASE WHEN c.conv_id % 4 < 3 THEN 'ok' ELSE 'failed' END AS status, " + ", ".join(f"CASE WHEN c.conv_id % 4 < 3 THEN round(coalesce({d}.{x}, 0), 6) END AS \"{d}_{m}\"" for d in ("D1", "D3") for m, x in _MEASURES.items()) + " FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w D1 ON D1.conv_id = c.conv_id AND D1.d = 'D1' LEFT JOIN w D3 ON D3.conv_id = c.conv_id AND D3.d = 'D3'")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its answers in another order; a case without ground truth failed."""
    return evaluated(spark, sf_dir)["summary"].select("exercise", "status", *[f"{d}_{m}" for d in ("D1", "D3") for m in _MEASURES])


@query(f"""WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM conversations WHERE conv_id % 4 < 3), n AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n FROM c GROUP BY 1),
r AS (SELECT conv_id, count(DISTINCT t) AS r FROM (SELECT conv_id, {_TRIM} AS t FROM c WHERE role = 'system' UNION ALL SELECT conv_id, {_TRIM.replace('text', 'said')} FROM c WHERE role = 'assistant' AND said IS NOT NULL) WHERE t <> '' GROUP BY 1)
SELECT dimension, CAST(sum(CASE dimension WHEN 'D4' THEN coalesce(r, 0) * greatest(n, 1) ELSE n * n END) AS BIGINT) AS pairs FROM n LEFT JOIN r USING (conv_id), unnest(['D1', 'D3', 'D4']) AS t(dimension) GROUP BY 1""")
def evaluation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all dimensions in one table."""
    return evaluated(spark, sf_dir)["matrix"].groupBy("dimension").agg(F.count(F.lit(1)).alias("pairs"))


# -- samples that keep what was chosen before

@query(f"""WITH t AS (SELECT doc_id, doc_id % 5 AS f, lower({_FLAT}) AS key FROM documents WHERE {_FLAT} <> ''), d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1),
r AS (SELECT key, min(doc_id) AS since FROM t WHERE doc_id % 100 = 0 GROUP BY key), o AS (SELECT d.doc_id, key, row_number() OVER (ORDER BY since) AS pick FROM d JOIN r USING (key)),
m AS (SELECT doc_id, f, row_number() OVER (PARTITION BY f ORDER BY doc_id) AS t FROM d WHERE key NOT IN (SELECT key FROM o)),
e AS (SELECT doc_id, pick FROM o UNION ALL SELECT doc_id, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY t, f) FROM m)
SELECT doc_id, pick FROM e WHERE pick <= 20""")
def retained_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: twenty statements, those chosen before that are still there first, then field by field."""
    docs = table(spark, sf_dir, "documents")
    field = F.get(F.array(*map(F.lit, sampling.FIELDS)), (c("doc_id") % 5).cast("int"))
    key = [folded(c("text"))]
    before = docs.where("doc_id % 100 = 0").select(F.struct(key[0].alias("k0")).alias("__key"), c("doc_id").alias("at"))
    before = before.unionByName(spark.createDataFrame([(("gone",), -1)], "__key struct<k0:string>, at long"))
    return sampling.balanced(docs.select("doc_id", field.alias("field"), "text"), key, "doc_id", 20, before).select("doc_id", c("pick").cast("long").alias("pick"))


@query("SELECT doc_id, 'plain_text/m-1/' || lang || '/v/pc' || doc_id || '_q1_' || short || '.txt' AS target FROM documents, unnest(['seq', 'acc', 'gtf', 'self']) AS t(short) WHERE doc_id % 3 > 0")
def jobs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer jobs by variation, protocol and model, without those whose output is there."""
    root, docs = folder(spark, "outputs"), table(spark, sf_dir, "documents")
    inputs = docs.select("doc_id", c("doc_id").cast("string").alias("pc"), F.lit("1").alias("q"), c("lang").alias("language"))
    every = conversion.answer_jobs(inputs, ["v"], list(T.STRATEGIES), ["m/1"])
    sinks.export(every.where("doc_id % 3 = 0").select("target", F.lit("x").alias("text")), root)
    return conversion.without_done(every, sinks.existing(spark, root)).select("doc_id", "target")
