"""Row numbers over a whole table without a single task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str, name: str = "number", parts: int | None = None) -> DataFrame:
    """rows with their number, from 1, in the order of a numeric column.

    Quantiles cut the order into ranges; a range's first number comes from the
    counts of those before it, and rows are ranked within their range.  The cuts
    and the counts are as many as shuffle partitions, whatever the table's size.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    span = F.lit(0)
    for cut in sorted(set(found or [])):
        span = span + F.when(F.col(order) > cut, 1).otherwise(0)
    cut_up = rows.withColumn("__span", F.coalesce(span, F.lit(-1)))
    counts = cut_up.groupBy("__span").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__span", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__span").orderBy(order))
    return cut_up.withColumn("__inner", inner).join(F.broadcast(counts), "__span").withColumn(name, F.col("__before") + F.col("__inner")).drop("__span", "__before", "__inner")
