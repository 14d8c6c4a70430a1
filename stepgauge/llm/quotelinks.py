"""Quotation linking (DataFrame operations only).

Every line of a message has a quote level: the number of ``>`` before it.  A
message's own passages are its lines of level 0, its quoted ones the others;
passages are normalised (white space, case) and hashed.  Quoted passages are
joined to the message of the same conversation that first wrote them, if that
is an earlier one; the message answers the one from which it quotes most at its
lowest linked level (of ties the later).  Conversations are ordered by what is
answered, then by turn, which puts every reply behind its original, and hold the
messages without their quotes and without the line that introduces a quote.
A conversation is a row for each message with the key of its place, so that one
of any length needs no task of its own; rows come in no order of their own.

Cases: null and empty texts have no passages and stay; a quote that no earlier
message wrote links nothing; a message without a link answers the turn before
it; repeated rows are linked alike; passages that are common in a conversation
lead to their first author only; null keys are ordered first and never linked;
an empty table gives no rows.  Only the columns named are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """level and body of each line."""
    def one(line: Column) -> Column:
        mark = F.regexp_extract(line, r"^[> \t]*", 0)
        level = F.length(mark) - F.length(F.replace(mark, F.lit(">")))
        return F.struct(level.alias("level"), F.when(level > 0, line.substr(F.length(mark) + 1, F.length(line))).otherwise(line).alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def normalised(body: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(body, r"\s+", " ")))


def unquoted(parts: Column) -> Column:
    """The lines of level 0 but those that end in 'wrote:' (any case) before a quote."""
    n = F.size(parts)
    intro = lambda i: F.lower(F.rtrim(F.element_at(parts, i + 1)["body"])).endswith("wrote:") & (i + 2 <= n) & (F.get(parts, i + 1)["level"] > 0)
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), F.coalesce(intro(i), F.lit(False)).alias("intro"))), lambda x: (x["level"] == 0) & ~x["intro"])
    return F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, version, level, hash, size of each passage."""
    part = F.explode(lines(F.col("text"))).alias("p")
    rows = messages.select("conv_id", "turn", F.xxhash64("text").alias("version"), part).where("conv_id is not null and turn is not null")
    rows = rows.select("conv_id", "turn", "version", "p.level", normalised(F.col("p.body")).alias("passage")).where("passage != ''")
    return rows.select("conv_id", "turn", "version", "level", F.sha2("passage", 256).alias("hash"), F.length("passage").alias("size"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, version, parent_turn, quoted_level, quoted_passages: the message that each quoting message answers."""
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    quoted = passages(quoting).where("level > 0").distinct()
    first = passages(messages).where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    # ``first`` has one row for a passage, so a passage that is quoted very often makes no pairs; its rows are dealt out as a skewed join
    met = quoted.join(first, ["conv_id", "hash"]).where("origin < turn")
    key = ["conv_id", "turn", "version"]
    voted = met.groupBy(*key, "level", "origin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("passages"))
    best = voted.groupBy(*key).agg(F.max(F.struct(-F.col("level"), "size", "origin", "passages")).alias("b"))
    return best.select(*key, F.col("b.origin").alias("parent_turn"), (-F.col("b.col1")).cast("int").alias("quoted_level"), F.col("b.passages").alias("quoted_passages"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), parent_turn, quoted_level, quoted_passages, reply_key.

    reply_key orders a conversation's messages: by the turn that they answer
    (the turn before, where no quote tells), then by their own turn.
    """
    found = links(messages)
    parts = lines(F.col("text"))
    once = F.get(F.transform(F.array(parts), unquoted), 0)  # the lines are split once
    rows = messages.select("conv_id", "turn", "role", F.when(F.col("text").rlike(r"(?m)^[ \t]*>"), once).otherwise(F.col("text")).alias("text"), F.xxhash64("text").alias("version"))
    out = rows.join(found, ["conv_id", "turn", "version"], "left")
    before = F.coalesce("parent_turn", F.col("turn") - 1)
    out = out.withColumn("reply_key", F.format_string("%019d.%019d", before + 1, F.col("turn")))
    return out.select("conv_id", "turn", "role", "text", "parent_turn", "quoted_level", F.coalesce("quoted_passages", F.lit(0)).alias("quoted_passages"), "reply_key")
