"""Text functions on the slips and layouts that they are for."""

import pytest
from pyspark.sql import functions as F

from stepgauge.functions import rewrite
from stepgauge.functions import text as T


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [
    ("  %% \\titledquestion{A\nb} ", "A b"), ("\\begin{itemize}\\item[i] x\\end{itemize} :;", "x"), ("done (Step 12).", "done"), ("", ""), ("\xa0a\u2003 b\x1f", "a b"),
])
def test_clean_latex_alike_in_both_dialects(spark, raw, want):
    assert one(spark, T.clean_latex(F.col("t")), t=raw) == want == T.LATEX.text(raw)


def test_white_space_is_unicode(spark):
    raw = "\u2003a \t\n b\xa0\xa0c\u3000"
    assert one(spark, rewrite.collapsed(F.col("t")), t=raw) == "a b c" == rewrite.COLLAPSE.text(raw)
    assert one(spark, rewrite.strip(F.col("t")), t=raw) == raw.strip()


def test_sentence_ends_and_conjunctions(spark):
    assert one(spark, T.without_sentence_end(F.col("t")), t="x.$") == "x$"
    assert one(spark, T.without_trailing_and(F.col("t")), t="a et") == "a"
    assert one(spark, T.without_leading_and(F.col("t")), t="and b") == "b"


@pytest.mark.parametrize("raw,want", [
    ("a\n```yaml\nk: 1\n```\nb", "k: 1"), ("```\nk: 2\n```", "k: 2"), ("x ```yml\nk: 3", "k: 3"), ("<think>```yaml\nno\n```</think>k: 4", "k: 4"), ("", ""),
])
def test_fences(spark, raw, want):
    assert one(spark, T.fenced(F.col("t")), t=raw) == want


def test_yaml_lines_are_repaired(spark):
    raw = '- {x} y\n- {k: v}\n- **b** "q"\n- "a\\b \'c\'"\n- !python/tuple\nplain\n'
    want = '- "{x} y"\n- {k: v}\n- "**b** \\"q\\""\n- \'a\\b \'\'c\'\'\'\n- !!python/tuple\nplain'
    assert one(spark, T.repaired_yaml(F.col("t")), t=raw) == want
    from stepgauge.operators.generate import tidy

    assert tidy(raw) == want


def test_blocks_and_their_count(spark):
    raw = "Exercise: x\n\nQuestion 1:\na\n\nAnswer:\nb\n\nQuestion 2:\nc\n"
    assert one(spark, T.question_blocks(F.col("t")), t=raw) == ["Question 1:\na\n\nAnswer:\nb", "Question 2:\nc"]
    assert one(spark, T.expected_blocks(F.col("t")), t=raw) == 2
    assert one(spark, T.expected_blocks(F.col("t")), t="Réponse:\nx\nanswer :\ny") == 2
    assert one(spark, T.expected_blocks(F.col("t")), t="none") is None
    assert one(spark, T.question_blocks(F.col("t")), t="none") == ["none"]


def test_formulas_and_words(spark):
    raw = r"$$a+b$$ or $c$ \[d\] \(e\) $$ $$"
    assert one(spark, T.source_formulas(F.col("t")), t=raw) == ["a+b", "c", "d", "e"]
    assert one(spark, T.bare_formula(F.col("t")), t=r"$ A \, + \quad b$") == "a+b"
    assert one(spark, T.content_tokens(F.col("t")), t="The café x² of É_à2 and CAFÉ") == ["café", "x²", "à2"]


def test_templates_are_filled_in_once(spark):
    assert one(spark, T.rendered("$a ${b} $$5 $c", {"a": F.col("a"), "b": F.col("b")}), a="$b", b=None) == "$b  $5 $c"


def test_names(spark):
    assert one(spark, T.path_safe(F.col("t")), t="/a:b c\\") == "a-b-c"
    assert T.encoder_slug("sentence-transformers/all-MiniLM-L6-v2") == "all-minilm-l6-v2" and T.encoder_slug("x/Y_z.1") == "y-z-1"
    assert one(spark, T.file_stem(F.col("t")), t="a/b.c.yaml") == "b.c"
    assert one(spark, T.tagged_items(F.col("t"), "ASSUMPTION"), t="%@ASSUMPTION one. %@ASSUMPTION two %@ASSUMPTION_END %@ASSUMPTION %@QUESTION q") == ["one", "two"]
    assert one(spark, T.question_text(F.col("t")), t="x %@QUESTION what %@ASSUMPTION if %@QUESTION_END rest") == "what if"
    assert one(spark, T.strength(F.col("t")), t=" .5e1 high") == 5.0 and one(spark, T.strength(F.col("t")), t="high") is None
