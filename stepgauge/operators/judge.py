"""A second opinion on pairs that the embeddings leave open.

Decisions are a table by key.  Pairs in the band ask for their key's decision:
those that are known are joined, the others are asked for once each, and what
was asked for (errors too) is what the table grows by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgauge.functions.measures import clamped, rounded
from stepgauge.functions.text import judge_key, rendered, strip

# Labels of decisions and the scores that they stand for.
LABEL_SCORES = {"equivalent": 1.0, "related_but_not_equivalent": 0.5, "unrelated": 0.0}
DECISION = "cache_key string, label string, confidence double, reason string, raw_response string"

#: Gives the response to a prompt.
Judge = Callable[[str], str]


def in_band(score: Column, low: Column | float, high: Column | float, predicted: Column) -> Column:
    """Whether a pair goes to the judge: its rounded score is within the band (both ends too) and there is a prediction."""
    return score.between(low, high) & predicted.isNotNull()


def parse(response: Column) -> dict[str, Column]:
    """label, confidence, reason of a response's YAML lines; label judge_error where it can't be used."""
    text = strip(response)
    fence = r"(?s)```(?:yaml|yml)?\s*(.*?)\s*```"
    text = F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    value = lambda name: strip(F.regexp_replace(F.regexp_extract(text, rf"(?m)^{name}[ \t]*:[ \t]*(.*)$", 1), r"""^(['"])(.*)\1$""", "$2"))
    label, number = value("label"), value("confidence")
    confidence = F.when(number == "", F.lit(0.0)).otherwise(number.try_cast("double"))
    wrong = F.when(~text.rlike(r"(?m)^\w+[ \t]*:"), F.lit("judge response is not a YAML mapping")).when(~label.isin(*LABEL_SCORES), F.concat(F.lit("judge returned invalid label '"), label, F.lit("'"))).when(confidence.isNull(), F.lit("judge confidence must be numeric"))
    return {"label": F.when(wrong.isNotNull(), "judge_error").otherwise(label), "confidence": F.when(wrong.isNotNull(), 0.0).otherwise(clamped(confidence)), "reason": F.coalesce(wrong, value("reason"))}


def keyed(rows: DataFrame, template: str, model: str) -> DataFrame:
    """rows with the key of their decision."""
    return rows.withColumn("cache_key", judge_key(template, model, F.col("dimension"), F.col("field"), F.col("gt_text"), F.col("model_text")))


def decide(open_rows: DataFrame, known: DataFrame, template: str, judge: Judge) -> DataFrame:
    """DECISION rows for the keys of open_rows that are not known, each asked for once; a judge that fails is an error to keep."""
    names = {n: F.col(n) for n in ("dimension", "field", "gt_text", "model_text")}
    once = open_rows.groupBy("cache_key").agg(*[F.first(n).alias(n) for n in names]).join(known.select("cache_key"), "cache_key", "left_anti")
    asked = once.select("cache_key", rendered(template, names).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prompt in batch["prompt"]:
                try:
                    out.append((judge(prompt), None))
                except Exception as wrong:  # noqa: BLE001  whatever goes wrong is the decision
                    out.append(("", str(wrong)))
            yield pd.DataFrame({"cache_key": batch["cache_key"], "raw_response": [r for r, _ in out], "failed": [w for _, w in out]})

    got = asked.mapInPandas(run, "cache_key string, raw_response string, failed string")
    read = parse(F.col("raw_response"))
    failed = F.col("failed").isNotNull()
    return got.select(
        "cache_key", F.when(failed, "judge_error").otherwise(read["label"]).alias("label"), F.when(failed, 0.0).otherwise(read["confidence"]).alias("confidence"),
        F.coalesce("failed", read["reason"]).alias("reason"), F.when(failed | (read["label"] == "judge_error"), "").otherwise(F.col("raw_response")).alias("raw_response"),
    )


def applied(rows: DataFrame, decisions: DataFrame, low: Column | float, high: Column | float) -> DataFrame:
    """rows (with cache_key) after the judge: score and matched as decided, and the judge's columns.

    decisions has a column ``cache_hit``; an error leaves a row as it was.
    """
    ask = in_band(F.col("score"), low, high, F.col("model_atom_index"))
    decided = decisions.select(F.col("cache_key").alias("__ask"), *_DECIDED)
    # pairs that ask for nothing don't take part in the join, where they would all go to one task
    rows = rows.withColumn("__ask", F.when(ask, F.col("cache_key")))
    asked = rows.where("__ask is not null").join(decided, "__ask", "left")
    others = rows.where("__ask is null").select("*", *[F.lit(None).cast(decided.schema[c].dataType).alias(c) for c in _DECIDED])
    return overridden(asked.unionByName(others)).drop("cache_key")


_DECIDED = ["label", "confidence", "reason", "cache_hit"]


def overridden(rows: DataFrame) -> DataFrame:
    """rows with their decision's columns and its key ``__ask`` (null without one), as they are after the judge."""
    used, known = F.col("label").isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in LABEL_SCORES.items() for x in kv]), F.col("label"))
    return rows.withColumns({
        "judge_used": used, "judge_label": F.col("label"), "judge_confidence": rounded(F.col("confidence")), "judge_reason": F.col("reason"), "judge_cache_key": F.col("__ask"),
        "judge_cache_hit": F.col("cache_hit"), "judge_error": F.when(F.col("label") == "judge_error", F.col("reason")),
        "score": F.coalesce(known, F.col("score")), "matched": F.when(known.isNotNull(), F.col("label") == "equivalent").otherwise(F.col("matched")),
    }).drop("__ask", *_DECIDED)


def unjudged(rows: DataFrame) -> DataFrame:
    """rows with the judge's columns of a run without one."""
    text = F.lit(None).cast("string")
    return rows.withColumns({"judge_used": F.lit(False), "judge_label": text, "judge_confidence": F.lit(None).cast("double"), "judge_reason": text, "judge_cache_key": text, "judge_cache_hit": F.lit(None).cast("boolean"), "judge_error": text})


def counters(decisions: DataFrame) -> DataFrame:
    """How many decisions were asked for, known, and failed."""
    fresh = ~F.col("cache_hit")
    return decisions.agg(F.count_if(fresh).alias("calls"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(fresh & (F.col("label") == "judge_error")).alias("failures"))
