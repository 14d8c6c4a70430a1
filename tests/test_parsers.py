"""Parsers say the same as the plain expressions that they stand for, and parse a text once."""

import random
import re

import pytest
import yaml

from stepgauge.functions import text as T
from stepgauge.functions.rewrite import COLLAPSE, STRIP
from stepgauge.plans.catalogue import proof_flatten
from stepgauge.sources import proofs, trees

PARTS = ["%", " ", "\n", "\t", " ", "and", "et", " and", "et ", ".", ",", "$", ":", ";", "(Step 3)", "(Step", ").", "\\item[a]", "\\titledquestion{b}", "\\begin{itemize}", "\\end{enumerate}", "which directly gives ", "x", "So "]


@pytest.mark.parametrize("chain", [T.LATEX, T.SENTENCE_END, T.TRAILING_AND, T.LEADING_AND, T.OUTCOME_LEAD, T.TAGS_JOINED, T.QUESTION_MARKS, STRIP, COLLAPSE])
def test_a_step_that_is_left_out_would_change_nothing(chain):
    draw = random.Random(7)
    for _ in range(3000):
        text = want = "".join(draw.choices(PARTS, k=draw.randint(0, 7)))
        for pattern, into in chain.steps:
            want = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", into), want)
        assert chain.text(text) == want, repr(text)


def test_of_several_tags_on_a_line_the_first_in_order_counts():
    draw, tags = random.Random(3), [f"%@{t}" for t in proofs._ORDER] + ["%@ARGUMENT:CALCULX", "%@OUTCOMES", "%@ATOM", "x"]
    for _ in range(2000):
        line = draw.choice(["", " "]).join(draw.choices(tags, k=draw.randint(1, 4)))
        want = next((t for t in proofs._ORDER if proofs._TAGS[t].search(line)), None)
        assert min(proofs._ANY_TAG.findall(line), key=proofs._ORDER.index, default=None) == want, line


def test_a_text_is_parsed_once(spark, sf_dir):
    plan = proof_flatten(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


YAML = [
    "atoms", "subquestions", "- ", "  ", "\n", "\n  ", "\n- ", ": ", ":", "{", "}", "[", "]", ", ", ",", "'", '"', "\\", "\\n", "\\u00e9", "\\/", "\\(x\\)", "&a ", "*a", "a", "b c", "5", "1e5", "no", "~", "null", "true", "!!python/tuple ", "!!python/tuple", "!", "#", " # c",
    "|", "|\n  ", ">-\n ", "---", "\n---\n", "...", "%", "@", "`", "?", "? ", "\t", "é", " ", "\x07", "﻿", "\x85", "😀", "$", "=", "<<", "2020-01-01", "a:b", "::", "--", "- -", "arguments: [x]", "{preconditions: [], arguments: [a], outcomes: []}", "\r\n", "''", '""', "x" * 1030,
]
JSON = ['{"a":"b"}', '{"a": ["b\\n", "c\\/", "\\""]}', '{"a": {"b": null, "c": true}}', '{"a":1}', '{"a":1e5}', '{"a":"\\u00e9"}', '{"a":"\\ud83d\\ude00"}', '{"a":"é 😀"}', '{"a":" "}', '{"a":"b","a":"c"}', '{"' + "k" * 1100 + '":"v"}', '{"a":"' + "v" * 3000 + '"}', '{"a":[]}', "{}", '{"a":NaN}', '{"a":"b"} x', '{"a":"x\x7f"}', '{"a"\n:"b"}', '{"a":"\t"}', '{"a":"b",}', '{"":""}', '{"a":["b" , {"c":["d"]}]}', '{"a":"! ? |# : - {"}']


def test_plain_texts_are_read_as_the_loader_does():
    draw = random.Random(11)
    texts = JSON + ["".join(draw.choices(YAML, k=draw.randint(1, 8))) for _ in range(15000)] + ["".join(draw.choices([*JSON, '"', "x", ",", " "], k=2)) for _ in range(300)]

    def said(load, text):
        try:
            return repr(load(text))
        except (yaml.YAMLError, ValueError, TypeError) as wrong:
            return str(wrong)

    for text in texts:
        assert said(trees.documents, text) == said(lambda t: list(yaml.load_all(t, Loader=trees._Loader)), text), repr(text)


def test_strings_in_json_need_no_yaml(monkeypatch):
    monkeypatch.setattr(trees.yaml, "load_all", None)
    assert trees.first_mapping('{"subquestions":[{"atoms":[{"arguments":["x = \\"y\\""]}]}]}') == ({"subquestions": [{"atoms": [{"arguments": ['x = "y"']}]}]}, None)
