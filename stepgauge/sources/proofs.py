"""Annotated LaTeX exercises: tagged lines to proof trees.

A solution is read as a stream of events, one for each line that matters: a
container opens or closes, a field of an atom begins, or text goes on.  Atoms
collect text under their open field; containers hang on a stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgauge.functions import text as T
from stepgauge.schemas import ARROW_EXERCISE, EXERCISE
from stepgauge.sources.trees import _empty, dumped, exercise_row, once


class ProofError(ValueError):
    """A mistake in an annotation, with the line of the solution on which it is."""

    def __init__(self, message: str, line: int | None, source: str = "<latex>"):
        super().__init__(f"{source}:{line}: {message}" if line else f"{source}: {message}")


_FIELDS = {"PRECOND": "preconditions", "ARGUMENT": "arguments", "ARGUMENT:CALCUL": "arguments", "OUTCOME": "outcomes"}
_ORDER = ["STRENGTH", "PRECOND", "ARGUMENT:CALCUL", "ARGUMENT", "OUTCOME", "PRECOND_END", "ARGUMENT_END", "OUTCOME_END", "ATOM_END"]
_STRUCTURE = re.compile(r"%@(LIST|SET)_(START|END)\b")
_ATOM = re.compile(r"%@ATOM\b")
_TAGS = {name: re.compile(rf"%@{name}\b") for name in [*_ORDER, "ATOM"]}
#: Of two tags at one place the longer; it also comes first in order.
_ANY_TAG = re.compile(rf"%@({'|'.join(sorted(_ORDER, key=len, reverse=True))})\b")
_COMMENT = re.compile(r"(?<!\\)%")
# Preconditions that lose their final mark without a conjunction.
_LOSES_MARK = re.compile(r"standard Brownian motion|^\$X_0|^Assume ")


_ARGUMENT = T.LEADING_AND.then(T.TRAILING_AND, T.SENTENCE_END)
_QUESTION = T.QUESTION_MARKS.then(T.LATEX)


def _content(line: str) -> str:
    return (_COMMENT.split(line, maxsplit=1)[0] if "%" in line else line).strip()


def _finished(tag: str, text: str) -> str:
    """A field's text once all of it is read."""
    if tag == "ARGUMENT:CALCUL":
        return "Calculation"
    if tag == "ARGUMENT":
        text = _ARGUMENT.text(text)
        return text.replace("(or by taking", "or by taking")
    if tag == "OUTCOME":
        text = T.OUTCOME_LEAD.text(text)
        return T.SENTENCE_END.text(text) if re.search(T.OUTCOME_OPENINGS, text) else text
    short = T.TRAILING_AND.text(text)
    if short != text or _LOSES_MARK.search(text):
        return T.SENTENCE_END.text(short)
    return text


class _Atom:
    """An atom whose lines are being read."""

    def __init__(self, line: int):
        self.line, self.tag, self.text = line, None, []
        self.data: dict[str, Any] = {"preconditions": [], "arguments": [], "outcomes": []}

    def close_field(self) -> None:
        if self.tag:
            value = _finished(self.tag, T.LATEX.text(" ".join(self.text)))
            field = self.data[_FIELDS[self.tag]]
            if value and value not in field:
                field.append(value)
        self.tag, self.text = None, []

    def read(self, line: str, number: int) -> bool:
        """Take in a line; true at the atom's end."""
        tag = min(_ANY_TAG.findall(line), key=_ORDER.index, default=None) if "%@" in line else None
        if tag is None:
            text = _content(line)
            if self.tag and text:
                self.text.append(text)
            return False
        if tag.endswith("_END"):
            if self.tag and (text := _content(_TAGS[tag].split(line, maxsplit=1)[0])):
                self.text.append(text)
            self.close_field()
            return tag == "ATOM_END"
        self.close_field()
        if tag == "STRENGTH":
            value = re.sub(r"^:", "", _TAGS[tag].split(line, maxsplit=1)[1].strip()).strip()
            number_text = re.match(T.NUMBER, T.LATEX.text(value))
            if not number_text:
                raise ProofError(f"Invalid @STRENGTH value {value!r}; expected a numeric value.", number)
            self.data["strength"] = float(number_text[0])
        else:
            self.tag = tag
        return False

    def done(self) -> dict:
        self.close_field()
        if not self.data["arguments"]:
            raise ProofError("Atom has no @ARGUMENT or @ARGUMENT:CALCUL content.", self.line)
        return self.data


def proof(solution: str) -> Any:
    """The proof tree of a solution: lists are ordered, tuples are sets."""
    roots: list = []
    stack: list[tuple[str, list, int]] = []  # kind, children, line
    atom: _Atom | None = None
    containers = False

    def hang(child: Any) -> None:
        (stack[-1][1] if stack else roots).append(child)

    def end_atom() -> None:
        nonlocal atom
        if atom:
            hang(atom.done())
            atom = None

    for number, raw in enumerate(solution.split("\n"), 1):
        line = raw.strip()
        if "%@" not in line:
            if atom:
                atom.read(line, number)
        elif atom and "%@ATOM_END" in line and _TAGS["ATOM_END"].search(line):
            atom.read(line, number)
            end_atom()
        elif mark := _structure(line):
            end_atom()
            containers = True
            kind, what = mark
            if what == "START":
                stack.append((kind.lower(), [], number))
            elif not stack or stack[-1][0] != kind.lower():
                raise ProofError(f"Encountered @{kind}_END without matching @{kind}_START.", number)
            else:
                _, children, _ = stack.pop()
                hang(children if kind == "LIST" else tuple(_distinct(children)))
        elif _ATOM.search(line):
            end_atom()
            atom = _Atom(number)
            rest = _ATOM.split(line, maxsplit=1)[1].strip()
            if rest and not line.startswith("%"):
                atom.read(rest, number)
        elif atom:
            atom.read(line, number)
    end_atom()
    if stack:
        raise ProofError(f"Unclosed @{stack[-1][0].upper()}_START annotation.", stack[-1][2])
    return roots[0] if containers and len(roots) == 1 else roots


def _structure(line: str) -> tuple[str, str] | None:
    """Of several container tags on a line one counts: openings before ends, SET before LIST among openings."""
    found = {m.groups() for m in _STRUCTURE.finditer(line)}
    if not found:
        return None
    return next((x for x in (("SET", "START"), ("LIST", "START"), ("LIST", "END"), ("SET", "END")) if x in found), None)


def _distinct(children: list) -> Iterator[Any]:
    seen = set()
    for child in children:
        key = dumped(child)
        if key not in seen:
            seen.add(key)
            yield child


def _tagged(text: str, tag: str) -> list[str]:
    found = (T.LATEX.text(m[1]) for m in re.finditer(T.tagged_pattern(tag).replace(r"\z", r"\Z"), text))
    return [y for x in found if (y := T.SENTENCE_END.text(x) if tag == "ASSUMPTION" else x)]


def parse_exercise(latex: str) -> dict:
    """The mapping of an annotated exercise: context, assumption_global, subquestions."""
    text = T.TAGS_JOINED.text(latex)
    context = ""
    if m := re.search(r"(?s)%@CONTEXT\s*(.*?)(?=\\titledquestion|\\part|%@)", text):
        title = re.search(r"(?s)\\titledquestion\{(.*?)\}", text)
        context = T.LATEX.text(m[1]) or (T.LATEX.text(title[1]) if title else "")
    subquestions = []
    for part in re.split(r"\\part\b", text)[1:]:
        zone, begun, _ = part.partition(r"\begin{xsolution}")
        asked = re.search(r"(?s)%@QUESTION\b(.*)", zone)
        solution = re.search(r"(?s)\\begin\{xsolution\}(.*?)\\end\{xsolution\}", part) if begun else None
        subquestions.append({
            "question": _QUESTION.text(asked[1] if asked else zone),
            "assumptions": _tagged(zone, "ASSUMPTION"),
            "atoms": proof(solution[1]) if solution else [],
        })
    return {"context": context, "assumption_global": _tagged(text.split(r"\begin{parts}", 1)[0], "ASSUMPTION_GLOBAL"), "subquestions": subquestions}


def _safe(latex: str | None) -> dict | str:
    try:
        return parse_exercise(latex or "")
    except ProofError as wrong:
        return str(wrong)


def parsed(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with the columns of EXERCISE in place of the annotated LaTeX; ``error`` tells what is wrong with it."""
    def one(latex: pa.Array) -> pa.Array:
        return pa.array([_empty(x) if isinstance(x := _safe(t.as_py()), str) else exercise_row(x) for t in latex], ARROW_EXERCISE)

    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, once(F.arrow_udf(one, EXERCISE))(F.col(text)).alias("__e")).select(*rest, "__e.*")


def as_yaml(text: str = "text"):
    """A column with the YAML of annotated LaTeX; a text with mistakes raises them."""
    def one(latex: pa.Array) -> pa.Array:
        return pa.array([dumped(parse_exercise(t.as_py() or "")) for t in latex], pa.string())

    return F.arrow_udf(one, "string")(F.col(text))
