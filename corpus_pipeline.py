"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepgauge.llm import dartdedup, decontaminate, mixing, quality, shards
from stepgauge.llm.queries import mix_weights, table
from stepgauge.llm.store import Scratch

#: The mixture takes this share of the tokens that reach it; each document once at most.
SHARE = 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.remove_rejected(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return dartdedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of any benchmark item occurs go."""
    return decontaminate.remove_affected(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix of documents within its budget stays."""
    return mixing.mixed(docs, SHARE, weights=mix_weights()).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their shard and slot."""
    return shards.dealt(docs).select("row.*", "shard", "slot")


STAGES = [("quality classifier", classify), ("MinHash near-dedup", deduplicate), ("benchmark decontamination", clean), ("mixing sources", mix), ("sharding", shard)]

#: Not expressible in SQL: a trained network and hashed signatures decide what stays.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    scratch.drop(docs)
    return docs
