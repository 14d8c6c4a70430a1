"""What a prompt tells of the questions before: frames over an exercise's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.functions.text import question_block, rendered


def _joined(block: Column, frame) -> Column:
    return F.array_join(F.collect_list(block).over(frame), "\n\n")


def accumulated(rows: DataFrame, keys: list[str], order: str, question: str, label: str = "Question") -> DataFrame:
    """rows with ``history``: the questions up to each one."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("history", _joined(question_block(label, F.col(order), F.col(question)), frame))


def answered(rows: DataFrame, keys: list[str], order: str, question: str, answer: str, answer_label: str, label: str = "Question", empty: str = "none") -> DataFrame:
    """rows with ``history``: the questions before each one, with their answers; ``empty`` for the first."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    block = F.concat(question_block(label, F.col(order), F.col(question)), F.lit(f"\n\n{answer_label}:\n"), F.coalesce(answer, F.lit("")))
    history = _joined(block, frame)
    return rows.withColumn("history", F.when(F.count(F.lit(1)).over(frame) == 0, F.lit(empty)).otherwise(history))


def first_answer(*answers: Column, where: Column) -> Column:
    """The first answer that isn't empty; an error that tells where if there is none."""
    return F.coalesce(*[F.nullif(a, F.lit("")) for a in answers], F.raise_error(F.concat(F.lit("no reference answer for "), where.cast("string"))).cast("string"))


def prompt(header: str, strategy: str, values: dict[str, Column]) -> Column:
    """Header and strategy filled in, a blank line between them."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return strip(F.concat(strip(rendered(header, values)), F.lit("\n\n"), strip(rendered(strategy, values))))
