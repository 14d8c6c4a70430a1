"""Chains of regular-expression replacements, for columns and for plain strings.

The expressions are written in the dialect that Java and Python share, so one
chain serves both the plans and the few parsers that run in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \\s knows ASCII only.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: The same characters, one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class Rewrite:
    """Ordered (expression, replacement) pairs; replacements refer to groups as $1."""

    def __init__(self, *steps: tuple[str, str]):
        self.steps = steps
        self.compiled = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", into)) for p, into in steps]

    def column(self, c: Column) -> Column:
        for pattern, into in self.steps:
            c = _step(c, pattern, into)
        return c

    def text(self, s: str) -> str:
        for (pattern, into), (source, plain) in zip(self.compiled, self.steps, strict=True):
            if (source, plain) == _ENDS:
                s = s.strip(BLANKS)
            elif (may := _NEEDS.get(source)) is None or may(s):
                s = pattern.sub(into, s)
        return s

    def then(self, *others: Rewrite) -> Rewrite:
        return Rewrite(*self.steps, *(step for other in others for step in other.steps))


#: What a string must have for an expression to match at all; cheaper to look for than the expression.
_NEEDS = {
    r"(?s)\\titledquestion\{(.*?)\}": lambda s: "\\titledquestion{" in s,
    r"\\item\[[^\]]*\]": lambda s: "\\item[" in s,
    r"\\(?:begin|end)\{(?:itemize|enumerate)\}": lambda s: "\\" in s,
    rf"^(?:{BLANK}|%)+": lambda s: s[:1] in BLANKS or s[:1] == "%",
    r"\s*\(Step\s+\d+\)\.?$": lambda s: "(Step" in s,
    r"[ :;]+$": lambda s: s[-1:] in " :;\n",
    r"[.,](\$)?$": lambda s: s[-1:] in ".,$\n",
    r"\s+(?:and|et)$": lambda s: s.endswith(("and", "et", "\n")),
    r"^(?:and|et)\s+": lambda s: s.startswith(("and", "et")),
    r"^which directly gives\s+": lambda s: s.startswith("which"),
}
_ENDS, _RUNS = (rf"^{BLANK}+|{BLANK}+$", ""), (rf"{BLANK}+", " ")


def _step(c: Column, pattern: str, into: str) -> Column:
    """A step as a column; the two about white space don't need the regular expression's large class."""
    if (pattern, into) == _ENDS:
        return F.btrim(c, F.lit(BLANKS))
    if (pattern, into) == _RUNS:
        return F.regexp_replace(F.translate(c, BLANKS, " " * len(BLANKS)), " {2,}", " ")
    return F.regexp_replace(c, pattern, into)


STRIP = Rewrite(_ENDS)
COLLAPSE = Rewrite(_RUNS).then(STRIP)


def strip(c: Column) -> Column:
    """Without white space at either end (SQL's trim takes spaces only)."""
    return STRIP.column(c)


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return COLLAPSE.column(c)


def folded(c: Column) -> Column:
    """Collapsed and in lower case: what tells statements apart."""
    return F.lower(collapsed(c))


def statements(values: Column) -> Column:
    """An array's texts without white space at the ends; blank and null ones go."""
    return F.filter(F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), strip), lambda x: x != "")
