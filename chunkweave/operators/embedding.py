"""Embedding of text columns, vector checks, and reuse of vectors by content hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.text import let, sha256
from chunkweave.functions.vectors import UNIT_TOLERANCE, half_precision, l2_normalize, off_unit, violation
from chunkweave.functions.wordbag import Embedder

BATCH_TEXTS = 256
MIN_HASH_CHARS = 32


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("hash", sha256(F.col("text")))


def embed_texts(
    texts: DataFrame, embedder: Embedder, *, key: str = "hash", text: str = "text", batch_texts: int = BATCH_TEXTS
) -> DataFrame:
    """``(key, text)`` to ``(key, vec array<float>)``, calling the embedder on fixed-size batches.

    The embedder must give one row per text. Batches are pure functions of their rows, so a lost
    executor only costs its own batches.
    """
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_texts):
                part = batch.slice(start, batch_texts)
                matrix = np.asarray(embedder(part.column(1).to_pylist()), dtype=np.float32)
                if matrix.ndim != 2 or matrix.shape[0] != part.num_rows:
                    raise ValueError(f"embedder gave {matrix.shape} for {part.num_rows} texts")
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * matrix.shape[1]
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[key, "vec"])

    return texts.select(key, text).mapInArrow(run, f"{key} {key_type}, vec array<float>")


def first_by_hash(cached: DataFrame) -> DataFrame:
    """``(hash, ord, vec)`` to one vector per hash, the earliest; short hashes are not trusted.

    ``min_by`` combines on the map side, so a hash repeated millions of times is one row per task
    before the shuffle.
    """
    return (
        cached.where(F.length("hash") >= MIN_HASH_CHARS)
        .groupBy("hash")
        .agg(F.min_by("vec", "ord").alias("vec"))
    )


def distinct_texts(chunks: DataFrame) -> DataFrame:
    return chunks.select("hash", "text").distinct()


def missing_texts(chunks: DataFrame, cache: DataFrame, key: list[str] | None = None, few: bool = False) -> DataFrame:
    """Distinct texts whose hash has no vector yet.

    With ``key``, the columns naming a chunk, the work is done on hashes: one chunk per missing hash
    is chosen (combined on the map side) and only then are texts fetched, by a join on unique keys.
    Texts are then shuffled once at most, and not at all if the caller has counted the missing
    hashes and found them ``few`` enough to broadcast.
    """
    known = cache.select("hash")
    if key is None:
        return distinct_texts(chunks).join(known, "hash", "left_anti")
    chosen = (
        chunks.groupBy("hash")
        .agg(F.min(F.struct(*key)).alias("chosen"))
        .join(known, "hash", "left_anti")
        .select(*[F.col(f"chosen.{k}").alias(k) for k in key])
    )
    return chunks.join(F.broadcast(chosen) if few else chosen, key, "left_semi").select("hash", "text")


def removed_hashes(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached hashes that no chunk has any more."""
    return cache.select("hash").distinct().join(chunks.select("hash").distinct(), "hash", "left_anti")


def reuse_counts(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: new_chunks, reused and to_embed by row, removed by distinct hash.

    Chunks shrink to one count per hash before they meet the cache.
    """
    per_hash = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("rows"))
    cached = cache.select("hash").distinct().withColumn("cached", F.lit(True))
    both = per_hash.join(cached, "hash", "full_outer")
    rows = F.coalesce("rows", F.lit(0))
    known = F.col("cached").isNotNull()
    return both.agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("new_chunks"),
        F.coalesce(F.sum(F.when(known, rows)), F.lit(0)).alias("reused"),
        F.coalesce(F.sum(F.when(~known, rows)), F.lit(0)).alias("to_embed"),
        F.count_if(known & F.col("rows").isNull()).alias("removed"),
    )


def incremental_vectors(
    chunks: DataFrame, cache: DataFrame, embedder: Embedder, *, key: list[str] | None = None, batch_texts: int = BATCH_TEXTS
) -> DataFrame:
    """One stored-precision vector per distinct hash: reused where known, embedded where not.

    ``chunks`` should be a stored table: the reuse branch then reads its hash column only.
    """
    reused = cache.select("hash", "vec").join(chunks.select("hash").distinct(), "hash", "left_semi")
    fresh = embed_texts(missing_texts(chunks, cache, key), embedder, batch_texts=batch_texts)
    return reused.withColumn("reused", F.lit(True)).unionByName(
        fresh.withColumn("reused", F.lit(False))
    ).withColumn("vec", half_precision(F.col("vec")))


def cache_matches(manifest: dict, model: str, max_seq_length: int | None, rows: int, vectors: int) -> bool:
    """Whether an earlier build may be reused: same model, compatible length, complete vectors."""
    spec = manifest.get("embedding") or {}
    known_length = spec.get("max_seq_length")
    return (
        spec.get("model") == model
        and (known_length is None or known_length == max_seq_length)
        and rows > 0
        and rows == vectors
    )


def vector_violations(vectors: DataFrame, dim: int | Column, vec: str = "vec") -> DataFrame:
    """Rows that must not be stored, with the reason."""
    return vectors.withColumn("problem", violation(F.col(vec), dim)).where(F.col("problem").isNotNull())


def checked_vectors(vectors: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """The same rows; the job fails on the first vector that must not be stored."""
    problem = violation(F.col(vec), dim)
    return vectors.withColumn(
        vec, F.when(problem.isNull(), F.col(vec)).otherwise(F.raise_error(F.concat(F.lit("bad vector: "), problem)))
    )


def unit_check(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: vectors, zero vectors, and whether all others have length one."""
    off = off_unit(F.col(vec))
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(off.isNull()).alias("zero_vectors"),
        F.coalesce(F.max(off) <= UNIT_TOLERANCE, F.lit(True)).alias("is_normalized"),
    )


def normalize_table(vectors: DataFrame, mode: str = "auto", vec: str = "vec") -> DataFrame:
    """``client`` always normalises, ``server`` never, ``auto`` only a table that is not unit length."""
    if mode == "server":
        return vectors
    unit = l2_normalize(F.col(vec)).cast("array<float>")
    if mode == "client":
        return vectors.withColumn(vec, unit)
    if mode != "auto":
        raise ValueError(f"unknown normalisation mode: {mode}")
    done = unit_check(vectors, vec).select("is_normalized").scalar()
    return vectors.withColumn(vec, F.when(done, F.col(vec)).otherwise(unit))


RESPONSE = "struct<data:array<struct<index:int,embedding:array<double>>>,model:string>"


def ordered_response(data: Column) -> Column:
    """``array<struct<index, embedding>>`` in index order; null unless indexes are 0..n-1."""
    return let(
        F.array_sort(F.transform(data, lambda d: F.struct(d["index"].alias("index"), d["embedding"].alias("embedding")))),
        lambda rows: F.when(
            F.forall(F.transform(rows, lambda r, i: r["index"] == i), lambda ok: ok),
            F.transform(rows, lambda r: r["embedding"]),
        ),
    )


def provider_key(provider: Column, text: Column) -> Column:
    """Cache key of a text for one provider."""
    return sha256(F.concat(provider, F.lit("|"), text))


def vector_shape(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"), F.min(F.size(vec)).alias("min_dim"), F.max(F.size(vec)).alias("max_dim")
    )
