"""Small guarded formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def rounded(c: Column) -> Column:
    """Six digits, halves away from zero; what lies within 1e-12 of a half counts as one, in whatever order it was added up."""
    return F.round(F.round(c, 2 * DIGITS), DIGITS)


def rounded_fast(c: Column) -> Column:
    """``rounded`` for very many rows: only what is near a half, or large, goes through decimals."""
    large = c * F.lit(10.0**DIGITS)
    whole = F.rint(large)
    return F.when((F.abs(large - whole) < 0.5 - 1e-5) & (F.abs(large) < 1e9), whole / F.lit(10.0**DIGITS) + 0.0).otherwise(rounded(c))


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole; ``empty`` where whole is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def midpoint(low: Column, high: Column) -> Column:
    return rounded((low + high) / 2)
