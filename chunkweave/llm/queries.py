"""Registered queries of this subpackage: ``name -> (query, SQL or None)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm import (
    ball_hashing,
    bpe,
    exact_topk,
    language_id,
    license_scans,
    mixing,
    ngram_join,
    quality_rules,
    secret_scans,
    sql,
    target_resampling,
    token_counts,
    url_filters,
    zone_clusters,
)
from chunkweave.llm.common import table, tokenizer_path


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact_topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, folder, "documents"), path), path))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scans.scan_licenses(table(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scans.digests(secret_scans.scan_secrets(table(spark, folder, "documents")))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, mixing.source_domain(F.col("source")), mixing.word_tokens(F.col("text")))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.table_counts(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return ball_hashing.near_duplicates(table(spark, folder, "documents"))


def op12_zone_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return zone_clusters.cluster_vectors(table(spark, folder, "embeddings"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return target_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, sql.QUALITY_RULES),
    "op2_exact_topk": (op2_exact_topk, sql.EXACT_TOPK),
    "op3_bpe": (op3_bpe, None),
    "op4_url_filters": (op4_url_filters, None),
    "op5_license_scans": (op5_license_scans, sql.LICENSE_SCANS),
    "op6_ngram_join": (op6_ngram_join, sql.NGRAM_JOIN),
    "op7_language_id": (op7_language_id, None),
    "op8_secret_scans": (op8_secret_scans, sql.SECRET_SCANS),
    "op9_mixing": (op9_mixing, sql.MIXING),
    "op10_token_counts": (op10_token_counts, None),
    "op11_simhash": (op11_simhash, None),
    "op12_zone_clusters": (op12_zone_clusters, sql.ZONE_CLUSTERS),
    "op13_resampling": (op13_resampling, sql.RESAMPLING),
}
