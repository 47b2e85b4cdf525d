"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, licensescan, linededup, mixing, packing, quality, secretscan, simhash, tokencount, topk
from .common import read


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents"))
    p = F.round("p__", 5).alias("p")
    return found.select("doc_id", "source", "lang", F.col("topic__").alias("topic"), p, F.col("kept__").alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents")).drop("row_key", "lang", "source")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    return found.withColumn("base_sha256", digest).drop("base_spans")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_boilerplate(read(spark, sf_dir, "documents"), count="n_removed")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensescan.scan_licenses(licensescan.document_paths(read(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(found["fp"]).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_text, op2_secret_scan, op3_top_k, op4_line_dedup, op5_license_scan, op6_packing, op7_simhash, op8_token_counts, op9_mixing, op10_quality_rules]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": topk.ORACLE_SQL, "op4_line_dedup": linededup.ORACLE_SQL, "op9_mixing": mixing.oracle_sql()}
