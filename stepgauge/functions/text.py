"""Text functions on columns: annotated LaTeX, answers, formulas, prompts, names.

Everything here is a built-in expression, so it runs inside the plan's code.
"""

from __future__ import annotations

import re
from string import Template

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepgauge.functions.rewrite import BLANK, BLANKS, Rewrite, STRIP, collapsed, folded, strip

# The tags of annotated LaTeX.
TAG = r"%@(?:CONTEXT|ASSUMPTION_GLOBAL|ASSUMPTION(?:_END)?|QUESTION(?:_END)?|ATOM(?:_END)?|PRECOND(?:_END)?|ARGUMENT(?:_END|:CALCUL)?|OUTCOME(?:_END)?|STRENGTH|LIST_START|LIST_END|SET_START|SET_END)\b"

# Words of English and French that carry no content.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "if", "in", "is", "it", "of", "on", "or", "that", "the", "then", "this",
    "to", "we", "with", "un", "une", "et", "est", "sont", "au", "aux", "avec", "ce", "ces", "cette", "dans", "de", "des", "du", "en", "la", "le",
    "les", "par", "pour", "que", "qui", "sur",
]

# Prompt protocols and their abbreviations.
STRATEGIES = {"strictly_sequential": "seq", "prompt_accumulation": "acc", "ground_truth_forcing": "gtf", "self_history": "self"}

# What these chains take away, in this order, and the patterns of formulas and numbers below.
TAGS_JOINED = Rewrite((r"%\s+@", "%@"))
LATEX = Rewrite(
    (r"(?s)\\titledquestion\{(.*?)\}", "$1"),
    (r"\\item\[[^\]]*\]", ""),
    (r"\\(?:begin|end)\{(?:itemize|enumerate)\}", ""),
    (rf"^(?:{BLANK}|%)+", ""),
    (rf"{BLANK}+", " "),
).then(STRIP, Rewrite((r"\s*\(Step\s+\d+\)\.?$", ""), (r"[ :;]+$", "")))
SENTENCE_END = Rewrite((r"[.,](\$)?$", "$1"))
TRAILING_AND = Rewrite((r"\s+(?:and|et)$", "")).then(STRIP)
LEADING_AND = Rewrite((r"^(?:and|et)\s+", "")).then(STRIP)
THINKING = Rewrite((r"(?is)<think\b[^>]*>.*?</think>", ""))

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_QUESTION = r"^Question\s+\d+:"


# -- annotated LaTeX

def joined_tags(c: Column) -> Column:
    """'% @TAG' as '%@TAG'."""
    return TAGS_JOINED.column(c)


def clean_latex(c: Column) -> Column:
    """A statement's text without layout commands, comment marks and step numbers."""
    return LATEX.column(c)


def without_sentence_end(c: Column) -> Column:
    return SENTENCE_END.column(c)


def without_trailing_and(c: Column) -> Column:
    return TRAILING_AND.column(c)


def without_leading_and(c: Column) -> Column:
    return LEADING_AND.column(c)


def tagged_pattern(tag: str) -> str:
    """What stands behind a tag, to its end, the next tag, the solution, the next part or the end of the text."""
    return rf"(?s)%@{tag}\b\s*(.*?)(?=%@{tag}_END\b|{TAG}|\\begin\{{xsolution\}}|\\end\{{xsolution\}}|\\part\b|\z)"


def tagged_items(c: Column, tag: str) -> Column:
    """The cleaned texts behind each occurrence of a tag; assumptions lose their final mark."""
    found = F.transform(F.regexp_extract_all(c, F.lit(tagged_pattern(tag)), F.lit(1)), clean_latex)
    if tag == "ASSUMPTION":
        found = F.transform(found, without_sentence_end)
    return F.filter(found, lambda x: x != "")


def has_tag(c: Column, tag: str) -> Column:
    return c.rlike(rf"%@{tag}\b")


def after_tag(c: Column, tag: str) -> Column:
    return strip(F.regexp_replace(c, rf"(?s)^.*?%@{tag}\b", ""))


def before_tag(c: Column, tag: str) -> Column:
    return strip(F.get(F.split(c, rf"%@{tag}\b", 2), 0))


def without_comment(c: Column) -> Column:
    """A line up to its first % that is not escaped."""
    return strip(F.get(F.split(c, r"(?<!\\)%", 2), 0))


def is_plain_comment(c: Column) -> Column:
    """A comment line that holds no tag."""
    return F.startswith(strip(c), F.lit("%")) & ~c.rlike(TAG)


QUESTION_MARKS = Rewrite((r"(?s)%@QUESTION_END\b.*", ""), (r"%@ASSUMPTION(?:_END)?\b", " "), (TAG, " "))


def question_text(zone: Column) -> Column:
    """The question in the text before a solution; the text of its assumptions stays in it."""
    marked = F.regexp_extract(zone, r"(?s)%@QUESTION\b(.*)", 1)
    return clean_latex(QUESTION_MARKS.column(F.when(zone.rlike(r"%@QUESTION\b"), marked).otherwise(zone)))


def clean_argument(c: Column) -> Column:
    return F.replace(without_sentence_end(without_trailing_and(without_leading_and(c))), F.lit("(or by taking"), F.lit("or by taking"))


# Openings after which an outcome loses its final mark.
OUTCOME_OPENINGS = r"^(?:\\\(|So |The process is therefore|This always gives)"
OUTCOME_LEAD = Rewrite((r"^which directly gives\s+", ""))


def clean_outcome(c: Column) -> Column:
    c = OUTCOME_LEAD.column(c)
    return F.when(c.rlike(OUTCOME_OPENINGS), without_sentence_end(c)).otherwise(c)


NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"


def strength(c: Column) -> Column:
    """The number at the start of a text; null if there is none."""
    return F.regexp_extract(strip(c), NUMBER, 0).try_cast("double")


# -- generated answers

def without_thinking(c: Column) -> Column:
    return THINKING.column(c)


def fenced(c: Column, languages: str = "yaml|yml") -> Column:
    """The payload of a response: of a YAML fence, else any fence, else an unclosed one, else all of it."""
    text = strip(without_thinking(c))
    part = lambda pattern, k=1: strip(F.regexp_extract(text, pattern, k))
    named, plain, opened = rf"(?is)```(?:{languages})\s*(.*?)```", r"(?s)```\s*(.*?)```", rf"(?is)```(?:{languages})?\s*(.*)"
    return F.when(text.rlike(named), part(named)).when(text.rlike(plain), part(plain)).when(text.rlike(opened), part(opened)).otherwise(text)


def split_lines(c: Column) -> Column:
    """Lines as Python's splitlines gives them: no empty one at the end."""
    return F.split(F.regexp_replace(c, rf"(?:{_LINE_BREAK})\z", ""), _LINE_BREAK, -1)


def tuple_tags(c: Column) -> Column:
    return F.regexp_replace(c, "!+python/tuple", "!!python/tuple")


def quoted_list_scalar(line: Column) -> Column:
    """A list item that begins with { or ** in double quotes, unless it is a mapping."""
    pattern = r"^(\s*-\s+)(\{.*|\*\*.*)$"
    head, value = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(line.rlike(pattern) & ~value.rlike(r"^\{\s*['\"]?[\w-]+['\"]?\s*:"), F.concat(head, F.lit('"'), quoted, F.lit('"'))).otherwise(line)


def single_quoted_latex(line: Column) -> Column:
    """A double-quoted list item with a backslash in single quotes, in which YAML leaves it alone."""
    pattern = r'^(\s*-\s+)"(.*)"(\s*)$'
    part = lambda k: F.regexp_extract(line, pattern, k)
    return F.when(line.rlike(pattern) & F.contains(part(2), F.lit("\\")), F.concat(part(1), F.lit("'"), F.replace(part(2), F.lit("'"), F.lit("''")), F.lit("'"), part(3))).otherwise(line)


def repaired_yaml(c: Column) -> Column:
    """The YAML text of a response with the slips of generated YAML put right, line by line."""
    return F.array_join(F.transform(split_lines(tuple_tags(c)), lambda x: quoted_list_scalar(single_quoted_latex(x))), "\n")


def expected_blocks(c: Column) -> Column:
    """How many questions an answer goes through: its question lines, else its answer lines, else null."""
    questions = F.regexp_count(c, F.lit(rf"(?dm){_QUESTION}\s*$"))
    answers = F.regexp_count(c, F.lit(r"(?dim)^(?:Answer|R[ée]ponse)\s*:\s*$"))
    return F.coalesce(F.nullif(questions, F.lit(0)), F.nullif(answers, F.lit(0)))


def question_blocks(c: Column) -> Column:
    """An answer's text from each question line to the next; all of it if it has none."""
    parts = F.transform(F.split(c, rf"(?dm)(?={_QUESTION})", -1), strip)
    blocks = F.filter(parts, lambda x: x.rlike(_QUESTION))
    return F.when(F.size(blocks) > 0, blocks).otherwise(F.array(c))


# -- content words and formulas

def content_tokens(c: Column) -> Column:
    """The distinct content words: runs of letters and digits of over one character that are no stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(*STOPWORDS)))


def bare_formula(c: Column) -> Column:
    """A formula without dollar signs, spacing commands and white space, in lower case."""
    return F.lower(F.translate(F.regexp_replace(F.replace(c, F.lit("$"), F.lit("")), r"\\(?:!|,|;|:|quad|qquad)", ""), BLANKS, ""))


FORMULAS = (r"(?s)\$\$(.+?)\$\$", r"(?s)(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)", r"(?s)\\\[(.+?)\\\]", r"(?s)\\\((.+?)\\\)")


def source_formulas(c: Column) -> Column:
    """The formulas in a text: $$..$$, $..$, \\[..\\], \\(..\\)."""
    return F.filter(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in FORMULAS]), lambda x: bare_formula(x) != "")


def formula_like(values: Column) -> Column:
    """Those of an array's texts that look like formulas."""
    return F.filter(values, lambda x: F.contains(x, F.lit("=")) | F.contains(x, F.lit("\\")) | x.rlike("[∫∑√≤≥→∞]"))


# -- prompts

def bullets(values: Column, empty: str) -> Column:
    """An array as a list of dashes; ``empty`` if it has nothing."""
    return F.when(F.size(F.coalesce(values, F.array())) > 0, F.array_join(F.transform(values, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(empty))


def question_block(label: str, number: Column, question: Column) -> Column:
    return F.concat(F.lit(f"{label} "), number.cast("string"), F.lit(":\n"), F.coalesce(question, F.lit("")))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with $name and ${name} filled in from columns, in one pass.

    The template is cut up while the plan is made, so values that hold dollar
    signs are never looked at again; unknown names stay as they are, $$ is $.
    """
    parts, at = [], 0
    for m in Template.pattern.finditer(template):
        name = m.group("named") or m.group("braced")
        if m.group("escaped") is not None:
            piece = F.lit("$")
        elif name in values:
            piece = F.coalesce(values[name].cast("string"), F.lit(""))
        else:
            continue
        parts += [F.lit(template[at : m.start()]), piece]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


# -- names and keys

def path_safe(c: Column) -> Column:
    """A model's name as a folder's: separators and blanks as dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[\/\\:\s]+", "-"), r"^-+|-+$", "")


def model_slug(c: Column) -> Column:
    return F.translate(F.lower(c), "/:._", "----")


# Short names of two encoders.
SHORT_ENCODERS = {"sentence-transformers/all-minilm-l6-v2": "all-minilm-l6-v2", "answerdotai/modernbert-base": "modernBert"}


def encoder_slug(name: str) -> str:
    """The folder of an encoder's calibration."""
    return SHORT_ENCODERS.get(name.lower()) or re.sub(r"[/:._]", "-", name.rsplit("/", 1)[-1].lower())


def concept_slug(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", *parts), r"[^a-zA-Z0-9]+", "_")


def file_stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)


def strategy_abbreviation(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), c)


def strategy_name(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in STRATEGIES.items() for x in (v, k)]), c)


def statement_key(source_file: Column, subquestion: Column, field: Column, atom_path: Column, text: Column) -> Column:
    """What identifies a statement in one language's inventory."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(file_stem(name(source_file)).alias("exercise"), name(subquestion).alias("subquestion"), name(field).alias("field"), name(atom_path).alias("path"), folded(name(text)).alias("text"))


def display(values: Column) -> Column:
    return F.array_join(values, " | ")


JUDGE_SCHEMA_VERSION = 2


def judge_key(template: str, model: str, dimension: Column, field: Column, gt_text: Column, model_text: Column) -> Column:
    """The SHA-256 under which a judge's decision is kept; anything that could change it is part of it."""
    parts = {"dimension": dimension, "field": field, "gt_text": gt_text, "judge_model": F.lit(model), "judge_schema_version": F.lit(JUDGE_SCHEMA_VERSION), "model_text": model_text, "prompt_template": F.lit(template)}
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])), 256)

