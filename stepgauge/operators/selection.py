"""How true a conversion is to its source, and which conversion wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgauge.functions.measures import f1, ratio, rounded
from stepgauge.functions.text import bare_formula, content_tokens, formula_like, source_formulas
from stepgauge.sources.config import RANKING_WEIGHTS, TIE_MARGIN


def _share(items: Column, blob: Column) -> Column:
    """The share of items that a text contains."""
    return ratio(F.size(F.filter(items, lambda x: F.contains(blob, x))), F.size(items))


def formula_fidelity(source: Column, statements: Column) -> Column:
    """F1 of candidate formulas found in the source and source formulas found in the candidate; 1 if neither has any."""
    bare = lambda c: F.filter(F.transform(c, bare_formula), lambda x: x != "")
    def of(parts: Column) -> Column:
        wanted, offered = parts["wanted"], parts["offered"]
        score = f1(_share(offered, bare_formula(source)), _share(wanted, F.array_join(offered, "")))
        return F.when((F.size(wanted) == 0) & (F.size(offered) == 0), 1.0).when((F.size(wanted) == 0) | (F.size(offered) == 0), 0.0).otherwise(score)

    parts = F.struct(bare(source_formulas(source)).alias("wanted"), bare(formula_like(statements)).alias("offered"))
    return F.get(F.transform(F.array(parts), of), 0)


def token_overlap(rows: DataFrame, source: str, statements: str) -> DataFrame:
    """rows with source_coverage (share of the source's content words that the candidate has) and non_hallucination (the reverse)."""
    rows = rows.withColumns({"__wanted": content_tokens(F.col(source)), "__offered": content_tokens(F.array_join(statements, "\n"))})
    rows = rows.withColumn("__both", F.size(F.array_intersect("__wanted", "__offered")))
    return rows.withColumns({"source_coverage": ratio(F.col("__both"), F.size("__wanted"), 1.0), "non_hallucination": ratio(F.col("__both"), F.size("__offered"))}).drop("__wanted", "__offered", "__both")


def completeness(atoms: Column) -> Column:
    """The mean over atoms of having arguments and having outcomes; 0 without atoms."""
    has = lambda a: F.when(F.size(a["arguments"]) > 0, 0.5).otherwise(0.0) + F.when(F.size(a["outcomes"]) > 0, 0.5).otherwise(0.0)
    return ratio(F.aggregate(atoms, F.lit(0.0), lambda s, a: s + has(a)), F.size(atoms))


def non_duplication(atoms: Column) -> Column:
    """Distinct atoms / atoms; 0 without atoms."""
    trimmed = lambda v: F.transform(v, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    plain = F.transform(atoms, lambda a: F.struct(*[trimmed(a[f]).alias(f) for f in ("preconditions", "arguments", "outcomes")]))
    return ratio(F.size(F.array_distinct(plain)), F.size(atoms))


def statements_of(atoms: Column) -> Column:
    return F.flatten(F.transform(atoms, lambda a: F.concat(a["preconditions"], a["arguments"], a["outcomes"])))


def components(rows: DataFrame, source: str, atoms: str) -> DataFrame:
    """rows with the five measures of a candidate (atoms) against its source; words and texts are taken apart once."""
    rows = rows.withColumn("__said", statements_of(F.col(atoms)))
    rows = rows.withColumns({"__wanted": content_tokens(F.col(source)), "__offered": content_tokens(F.array_join("__said", "\n"))})
    both = F.size(F.array_intersect("__wanted", "__offered"))
    rows = rows.withColumns({
        "formula_fidelity": formula_fidelity(F.col(source), F.col("__said")), "__both": both, "atom_completeness": completeness(F.col(atoms)), "non_duplication": non_duplication(F.col(atoms)),
    })
    rows = rows.withColumns({"source_coverage": ratio(F.col("__both"), F.size("__wanted"), 1.0), "non_hallucination": ratio(F.col("__both"), F.size("__offered"))})
    return rows.drop("__said", "__wanted", "__offered", "__both")


def weighted(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of the measures."""
    weights = weights or RANKING_WEIGHTS
    total = F.lit(0.0)
    for name in RANKING_WEIGHTS:
        total = total + parts[name] * F.lit(weights[name])
    return total / F.lit(sum(weights.values()))


def winners(scored: DataFrame, keys: list[str], name: str = "call2_model", score: str = "score", tie: float = TIE_MARGIN) -> DataFrame:
    """The best of each group (of equal scores the first name), its margin and whether it is close enough for a review."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(name))
    ranked = scored.withColumns({"__rank": F.row_number().over(w), "__next": F.lead(score).over(w)}).where("__rank = 1")
    margin = F.col(score) - F.col("__next")
    return ranked.withColumns({"selection_margin": rounded(margin), "needs_review": F.coalesce(margin <= F.lit(tie), F.lit(False))}).drop("__rank", "__next")


def selection_summary(responses: DataFrame, selected: Column) -> DataFrame:
    """How many groups have a winner."""
    n, got = F.count(F.lit(1)), F.count_if(selected)
    return responses.agg(n.alias("call1_responses"), got.alias("responses_selected"), (n - got).alias("all_candidates_failed"), rounded(got / n).alias("selection_coverage"))
