"""From raw documents to token ids: one job of five stages, each written as Parquet before the next.

1. ``language_id``: documents without a recognised language go, those in a language not learned included.
2. ``ngram_join``: of each group of near duplicates (word five-grams, similarity 0.8) one document stays.
3. ``secret_scans``: secrets in the texts are masked; the documents stay.
4. ``mixing``: domains, languages and sources are brought to their target weights.
5. ``bpe``: texts become token ids; decoding them again must give the text.

Every stage takes ``(spark, docs, folder)``, works on all rows and, but for the last, returns the columns
of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm import bpe, language_id, mixing, ngram_join, secret_scans
from chunkweave.llm.common import stored, table, tokenizer_path
from chunkweave.session import ship_package

MIN_LANGUAGE_SCORE = 0.5
SHARE_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    return language_id.with_language(docs, tokenizer_path("piece_bpe_32k.model"), MIN_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    return secret_scans.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    domain, tokens = mixing.source_domain(F.col("source")), mixing.word_tokens(F.col("text"))
    return mixing.selected(docs, domain, tokens, share_percent=SHARE_PERCENT, max_epochs=1)


def encode_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    found = bpe.encode_checked(docs, tokenizer_path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Learned models and token ids are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
