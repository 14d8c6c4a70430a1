"""Rules whose first failure counts, and repair of split rows, on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_fault(*rules: tuple[Column, Column | str]) -> Column:
    """The message of the first rule whose condition holds; null if none does.  Later rules are not looked at."""
    out = None
    for wrong, message in rules:
        message = F.lit(message) if isinstance(message, str) else message
        out = F.when(wrong, message) if out is None else out.when(wrong, message)
    return out


def merged_partials(items: Column, keys: list[str]) -> Column:
    """An array of partial records (a struct of nullable ``keys``) with neighbours put together.

    A record takes keys until one repeats or it has all; a fold, as where a record
    begins depends on all before it.  An item with all keys, or none of them,
    stands alone.
    """
    kind = "array<struct<" + ",".join(f"{k}:string" for k in keys) + ",open:boolean>>"
    whole = lambda x: F.lit(True) if not keys else _all([x[k].isNotNull() for k in keys])

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        nothing = _all([x[k].isNull() for k in keys])
        clash = _any([x[k].isNotNull() & last[k].isNotNull() for k in keys])
        joins = (F.size(done) > 0) & F.coalesce(last["open"], F.lit(False)) & ~whole(x) & ~nothing & ~clash
        both = [F.coalesce(last[k], x[k]).alias(k) for k in keys]
        joined = F.struct(*both, (~_all([F.coalesce(last[k], x[k]).isNotNull() for k in keys])).alias("open"))
        alone = F.struct(*[x[k].alias(k) for k in keys], (~whole(x) & ~nothing).alias("open"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(alone)))

    folded = F.aggregate(items, F.expr(f"cast(array() as {kind})"), step)
    return F.transform(folded, lambda x: F.struct(*[x[k].alias(k) for k in keys]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def asserted(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """rows; running the plan fails where the condition doesn't hold."""
    return rows.where(F.coalesce(ok, F.lit(False)) | F.raise_error(F.lit(message)).cast("boolean"))
