"""Statements of exercises, and imports and parses of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgauge.functions.rewrite import COLLAPSE
from stepgauge.schemas import ATOM_FIELDS, STATEMENT_COLUMNS
from stepgauge.sources import trees


def inventory(exercises: DataFrame) -> DataFrame:
    """STATEMENT_COLUMNS and pos of exercises(source_file, language, pc, exercise and the EXERCISE columns).

    Global assumptions have no subquestion; sets are written as tuples in paths.
    """
    keys = ["source_file", "language", "pc", "exercise"]
    texts = lambda c: F.posexplode(F.filter(F.transform(c, COLLAPSE.column), lambda x: x != "")).alias("__n", "text")

    def part(rows: DataFrame, field: str, values: Column, subquestion: Column, path: Column, place: Column) -> DataFrame:
        own = rows.select(*keys, subquestion.cast("string").alias("subquestion_index"), F.lit(field).alias("field"), path.alias("atom_path"), place.alias("__place"), texts(values))
        return own.withColumn("pos", F.struct("source_file", "__place", "__n")).drop("__place", "__n")

    place = lambda *c: F.array(*[F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in c])
    out = part(exercises, "assumption_global", F.col("assumption_global"), F.lit(""), F.lit("global"), place(0, 0, 0, 0))
    subs = exercises.select(*keys, F.posexplode("subquestions").alias("m", "sub")).withColumn("n", F.col("m") + 1)
    out = out.unionByName(part(subs, "assumptions", F.col("sub.assumptions"), F.col("n"), F.format_string("subquestions[%d].assumptions", "n"), place(F.col("n"), 0, 0, 0)))
    atoms = trees.atoms(exercises, keys)
    for k, field in enumerate(ATOM_FIELDS):
        out = out.unionByName(part(atoms.withColumnRenamed("subquestion_index", "n"), field, F.col(field), F.col("n"), trees.path(F.col("n"), F.col("steps"), "tuple"), place(F.col("n"), 1, F.col("atom_index"), k)))
    return out.select(*STATEMENT_COLUMNS, "pos")
