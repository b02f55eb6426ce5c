"""From raw documents to shards of a training mixture, in five stages.

Each stage takes what the one before kept: documents that the quality classifier rejects go; of
each group of near-duplicates one document stays; documents that hold a benchmark item go;
sources are repeated to equal shares; shards are interleaved so that each matches the mixture.

In every stage null ids, texts and sources, empty texts, repeated rows and extra columns pass like
others, by the rules that the stage's docstring states, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, neardup, quality, shards
from tessera.llm.common import cut, only, scratch, table

SHARDS = 8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more. Null and empty texts are scored as one empty passage; equal texts score alike, whatever their ids."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the row with the smallest id. Null and empty texts are linked with nothing and stay, and so do rows with a null id.

    Rows that repeat a kept id stay, unless they are near-duplicates under another id.
    """
    groups = neardup.near_groups(docs, percent=80)
    gone = cut(groups.where("NOT kept").select("doc_id").distinct())
    return only(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item. Null and empty texts and items match nothing; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat as often as their source's rate says. A null source is one of its own; rows with one id repeat alike."""
    return mixing.mix_sources(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot; columns of docs with those names are replaced. Equal rows take a place each."""
    return shards.shard_documents(docs, SHARDS)


STAGES = [("quality_classifier", classify), ("near_dedup", deduplicate), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
