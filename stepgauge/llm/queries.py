"""The queries of this subpackage: one per operator, and the pipeline's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgauge.llm import dartdedup, decontaminate, licenses, mixing, piececount, quality, quotelinks, shards, sketch, zipwarc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.suffix_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= decontaminate.MIN_ITEMS).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match"),
    )


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shards.dealt(docs)
    return out.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipwarc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The query's vocabulary, a file of the driver's.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op4_piece_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piececount.counted(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotelinks.conversations(table(spark, sf_dir, "conversations"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


#: Production parameters of the mixture: 60 % of the corpus's tokens, at most two epochs of a leaf, one domain favoured, English twice.
MIX = {"share": 0.6, "max_epochs": 2}


def mix_weights() -> dict:
    return {"domain": mixing.named_weights("domain", {"domain0": 2.0}), "lang": mixing.named_weights("lang", {"en": 2.0})}


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"), MIX["share"], weights=mix_weights(), max_epochs=MIX["max_epochs"])
    return out.select("row.doc_id", *mixing.LEVELS, F.col("tokens").alias("n_tokens"), "epoch", "budget")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartdedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_shards,
        op3_zip_warc,
        op4_piece_count,
        op5_quote_links,
        op6_quality,
        op7_bloom_sketch,
        op8_mixture,
        op9_license_scan,
        op10_near_dedup,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
heads AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS size, w[i : i + least(8, len(w)) - 1] AS head
  FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM heads),
places AS (
  SELECT rid, i, size, w[i : i + size - 1] AS head
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hits AS (SELECT rid, i, p.size, item_id FROM places p JOIN heads h ON p.size = h.size AND p.head = h.head),
words AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, size)) AS t(k) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid),
starts AS (SELECT DISTINCT item_id, i AS place, least(8, len(w)) AS size, w[i : i + least(8, len(w)) - 1] AS head FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0),
met AS (SELECT rid, item_id, p.i AS pos, p.i - place AS shift, p.size FROM places p JOIN starts s ON p.size = s.size AND p.head = s.head),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY rid, item_id, shift ORDER BY pos) AS run FROM met),
longest AS (SELECT rid, max(n) AS longest FROM (SELECT rid, count(*) + min(size) - 1 AS n FROM runs GROUP BY rid, item_id, shift, run) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid) LEFT JOIN longest USING (rid)
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS origin FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = origin THEN NULL ELSE origin END AS refers_to
FROM p JOIN first USING (h)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _OP1, "op3_zip_warc": _OP3}
