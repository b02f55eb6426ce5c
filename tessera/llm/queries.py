"""The thirteen operators and the pipeline as queries over the tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from . import blocks, decontaminate, dialogue, lines, manifest, mixing, neardup, packing, pseudonyms, quality, secrets, shards, substrings
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.exact_groups(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), percent=85)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digests(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.tessera.pii.key; without one, a public key that serves for trying the query out only."""
    key = spark.conf.get("spark.tessera.pii.key", None)
    if key is None:
        key = "public key of the registered query"
        warnings.warn("spark.tessera.pii.key is not set: pseudonyms are made with a key that everyone has", stacklevel=2)
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_table(table(spark, sf_dir, "documents")).drop("source")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "text", "source", "copy_no", "mix_key")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digests(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_digests(table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_dedup, op3_near_dedup, op4_quality, op5_substring_dedup, op6_pii, op7_sharding, op8_secrets, op9_mixing, op10_decontamination, op11_packing, op12_repair, op13_manifest, pipeline)}
SQL = {"op2_exact_dedup": blocks.SQL, "op3_near_dedup": neardup.SQL, "op5_substring_dedup": substrings.SQL, "op7_sharding": shards.SQL, "op9_mixing": mixing.SQL, "op12_repair": dialogue.SQL, "op13_manifest": manifest.SQL}
