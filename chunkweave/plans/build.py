"""Whole jobs: build a packet from sources, re-embed one, search one, enrich sources.

A packet is a folder of runs, and a manifest that names the tables of the current one: ``docs`` (one
row per chunk), ``vectors`` (one row per distinct text hash) and more. Each stage is written before
the next one reads it: that cuts the lineage at shared storage, lets later stages read only the
columns they need, and makes a re-run after lost executors cheap. The manifest comes last.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.text import is_blank, path_suffix, sha256, word_count
from chunkweave.functions.wordbag import Embedder
from chunkweave.operators import embedding as E
from chunkweave.operators import enrichment as N
from chunkweave.operators import integrity as I
from chunkweave.operators import search as S
from chunkweave.operators import windows as W
from chunkweave.operators.chunkers import structural_chunks
from chunkweave.operators.constraints import ENRICHED
from chunkweave.operators.enrichment import Enricher
from chunkweave.operators.packing import ChunkingOptions, TokenCounter
from chunkweave.operators.segments import explode_segments, segments_by_kind
from chunkweave.sources import packets as P
from chunkweave.sources.tables import buckets_for, key_value_text, read_by_hash, write_by_hash
from chunkweave.sources.tables import stored as stored_once

FEW_TEXTS = 200_000
VECTORS = "hash string, vec array<float>"


@dataclass(frozen=True)
class PacketSpec:
    """What a packet is called and how its vectors are made."""

    name: str
    version: str
    model: str
    max_seq_length: int | None = 1024
    description: str = ""
    fixed_tag: str = "corpus"
    lines_per_chunk: int = W.LINES_PER_CHUNK
    overlap_lines: int = W.OVERLAP_LINES
    normalization: str = "auto"


def _utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _metadata(**fields: Column) -> Column:
    return F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def line_window_chunks(sources: DataFrame, spec: PacketSpec, numbered: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(chunk_id, path, ord, text, hash, metadata)`` of fixed line windows, and the source columns to ``keep``."""
    rows = W.line_chunks(sources, spec.lines_per_chunk, spec.overlap_lines)
    rows = W.number_chunks(rows) if numbered else W.local_ids(rows)
    return rows.select(
        F.col("id").alias("chunk_id"),
        "path",
        "ord",
        "text",
        sha256(F.col("text")).alias("hash"),
        _metadata(path=F.col("path"), ext=F.col("ext")).alias("metadata"),
        *keep,
    )


def structural_chunk_rows(sources: DataFrame, options: ChunkingOptions, count: TokenCounter = word_count) -> DataFrame:
    rows = structural_chunks(sources, options, count=count)
    meta = _metadata(path=F.col("path"), ext=F.col("ext"), chunker=F.col("chunker"), blocks_meta=F.to_json("blocks_meta"))
    return rows.select(
        F.col("id").alias("chunk_id"), "path", "ord", "text", sha256(F.col("text")).alias("hash"), meta.alias("metadata")
    )


def usable_cache(spark: SparkSession, packet: str, spec: PacketSpec) -> DataFrame | None:
    """Vectors of an earlier build by hash, if it was made with the same model and no chunk lacks one."""
    manifest = P.read_manifest(spark, packet)
    if manifest is None:
        return None
    hashes = P.table_of(spark, packet, manifest, "docs").select("hash").distinct()
    vectors = P.table_of(spark, packet, manifest, "vectors").select("hash", "vec")
    found = hashes.join(vectors.select("hash", F.lit(1).alias("known")), "hash", "left").agg(
        F.count(F.lit(1)).alias("hashes"), F.count("known").alias("known")
    ).first()
    if not E.cache_matches(manifest, spec.model, spec.max_seq_length, found.hashes, found.known):
        return None
    return vectors


def write_in_hash_order(chunks: DataFrame, folder: str) -> None:
    """Chunks so that a few hashes are found in few files and row groups. Rows are dealt by the leading
    digits of the hash; Spark joins small parts and splits large ones, so a text copied often fills more
    than one."""
    dealt = chunks.withColumn("part_", F.substring("hash", 1, 2)).hint("rebalance", F.col("part_"))
    dealt.sortWithinPartitions("hash").drop("part_").write.parquet(folder)


def _dim_of(vectors: DataFrame) -> int | None:
    shape = E.vector_shape(vectors).first()
    return shape.max_dim if shape.vectors and shape.min_dim == shape.max_dim else None


def _extensions(chunks: DataFrame, folder: str, fixed_tag: str) -> tuple[dict[str, int], list[str]]:
    """Files per extension as a table of the run; the counts of known extensions and the tags."""
    spark = chunks.sparkSession
    files = chunks.select("path").distinct().select(path_suffix(F.col("path")).alias("ext")).where("ext <> ''")
    I.extension_counts(files).write.parquet(folder)
    counts = spark.read.parquet(folder)
    known = counts.where(F.col("ext").isin(*I.EXTENSION_TAGS)).collect()
    return {r.ext: r["files"] for r in known}, list(I.infer_tags(counts, fixed_tag).first().tags)


def materialize(
    chunks: DataFrame,
    out: str,
    spec: PacketSpec,
    embedder: Embedder,
    *,
    previous: str | None = None,
    run: str | None = None,
    extras: dict | None = None,
    extra_files: dict[str, str] | None = None,
) -> dict:
    """Write the packet of ``chunks`` below ``out`` and return its manifest.

    Vectors of ``previous`` are reused by hash when that build is compatible and of the same
    dimension; otherwise everything is embedded. ``previous`` may be ``out``: a build has a folder of
    its own and replaces the former one only when its manifest is put in place.
    """
    spark = chunks.sparkSession
    run = run or P.new_run(out)
    folder = f"{out}/{run}"
    write_in_hash_order(chunks, f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    nothing = spark.createDataFrame([], "hash string, vec array<float>")
    found = usable_cache(spark, previous, spec) if previous else None
    cache = found if found is not None else nothing

    counts = E.reuse_counts(stored, cache).first()
    if counts.new_chunks == 0:
        raise ValueError("no chunks found")
    few = counts.to_embed <= FEW_TEXTS
    missing = E.missing_texts(stored, cache, ["chunk_id"], few)
    E.embed_texts(missing, embedder).write.parquet(f"{folder}/fresh")
    fresh = spark.read.parquet(f"{folder}/fresh")
    reused = counts.reused
    fresh_dim = _dim_of(fresh) if counts.to_embed else None
    cache_dim = _dim_of(cache) if found is not None else None
    if fresh_dim and cache_dim and fresh_dim != cache_dim:
        # Another dimension: nothing can be reused, although ``removed`` still tells what went.
        cache, reused = nothing, 0
        E.embed_texts(E.distinct_texts(stored), embedder).write.parquet(f"{folder}/fresh_all")
        fresh = spark.read.parquet(f"{folder}/fresh_all")
    dim = fresh_dim or cache_dim
    if dim is None:
        raise ValueError("vectors of different dimensions")

    kept = cache.join(stored.select("hash").distinct(), "hash", "left_semi")
    vectors = E.normalize_table(E.checked_vectors(fresh, dim), spec.normalization).unionByName(kept)
    # Laid out by hash, so that the next build's hashes come to the vectors and not the other way round.
    layout = {"place": f"{run}/vectors", "key": "hash", "buckets": buckets_for(spark, counts.new_chunks, 4 * dim + 64), "schema": VECTORS}
    write_by_hash(vectors.withColumn("vec", E.half_precision(F.col("vec"))), f"{folder}/vectors", layout["key"], layout["buckets"])
    written = read_by_hash(spark, f"{folder}/vectors", VECTORS, layout["key"], layout["buckets"])
    complete = E.unit_check(written).first()
    ext_counts, tags = _extensions(stored, f"{folder}/extensions", spec.fixed_tag)
    manifest = {
        "schema_version": "1.0",
        "packet_id": spec.name,
        "embedding": {
            "model": spec.model,
            "dim": dim,
            "dtype": "float16",
            "normalized": bool(complete.is_normalized),
            "max_seq_length": spec.max_seq_length,
        },
        "similarity": {"space": "cosine", "index_type": "flat-ip"},
        "files": {
            "docs": f"{run}/chunks",
            "vectors": f"{run}/vectors",
            "extensions": f"{run}/extensions",
            **{name: f"{run}/{place}" for name, place in (extra_files or {}).items()},
        },
        "layout": {"vectors": layout},
        "counts": {"docs": counts.new_chunks, "vectors": written.count()},
        "source": {"file_ext_counts": ext_counts},
        "package": {"name": spec.name, "version": spec.version, "description": spec.description, "tags": tags},
        "incremental": {
            "enabled": found is not None,
            "reused": reused,
            "embedded": counts.new_chunks - reused,
            "removed": counts.removed,
        },
        **(extras or {}),
    }
    write_descriptor(spark, manifest, f"{folder}/descriptor")
    P.publish_manifest(spark, out, manifest)
    return manifest


def descriptor_text(manifest: dict) -> Column:
    """The manifest's package part as a key-value descriptor."""
    package, embedding = manifest["package"], manifest["embedding"]
    fields = {
        "name": package["name"],
        "version": package["version"],
        "description": package["description"],
        "tags": ",".join(package["tags"]),
        "embedding_model": embedding["model"],
        "embedding_dim": str(embedding["dim"]),
        "embedding_normalized": "true" if embedding["normalized"] else "false",
        "created_at": _utc_now(),
    }
    return key_value_text(F.create_map(*[F.lit(x) for pair in fields.items() for x in pair]))


def write_descriptor(spark: SparkSession, manifest: dict, folder: str) -> None:
    """The descriptor as a key-value text file."""
    spark.range(1).select(descriptor_text(manifest).alias("value")).coalesce(1).write.text(folder)


def build_packet(
    sources: DataFrame,
    out: str,
    spec: PacketSpec,
    embedder: Embedder,
    *,
    previous: str | None = None,
    options: ChunkingOptions | None = None,
    numbered: bool = False,
    count: TokenCounter = word_count,
) -> dict:
    """Sources to a packet of line windows, or of structural chunks, measured by ``count``, when
    ``options`` are given."""
    chunks = structural_chunk_rows(sources, options, count) if options else line_window_chunks(sources, spec, numbered)
    return materialize(chunks, out, spec, embedder, previous=previous)


def reembed_packet(spark: SparkSession, packet: str, out: str, spec: PacketSpec, embedder: Embedder) -> dict:
    """A packet with another model from the chunks of an existing one, which it may replace; sources
    are not read."""
    return materialize(P.packet_table(spark, packet, "docs"), out, spec, embedder)


def _previous_table(spark: SparkSession, packet: str | None, name: str, schema: str) -> DataFrame:
    """A table of an earlier build; empty if there is no such build or table."""
    manifest = P.read_manifest(spark, packet) if packet else None
    return P.table_of(spark, packet, manifest or {}, name, schema)


@dataclass(frozen=True)
class EnrichmentSpec:
    """Settings that shape an enrichment; all of them are part of the cache key."""

    model: str
    prompt_version: str = "v1"
    max_chunk_tokens: int = 800
    min_chunk_tokens: int = 120
    max_segments_per_request: int = 8


def enrich_packet(
    sources: DataFrame,
    out: str,
    spec: PacketSpec,
    embedder: Embedder,
    enricher: Enricher,
    enrichment: EnrichmentSpec,
    *,
    previous: str | None = None,
) -> dict:
    """Sources to a packet of enriched segments.

    Segments enriched by ``previous`` under the same settings are reused. The service's answers are
    written before anything uses them, so no request is sent twice.
    """
    spark = sources.sparkSession
    e = enrichment
    run = P.new_run(out)
    folder = f"{out}/{run}"
    found = sources.where(~is_blank(F.col("content")))
    files = N.classify(found.withColumn("source_hash", sha256(F.col("content")))).where("is_supported_text")
    key = N.segment_cache_key(
        e.model, e.prompt_version, e.max_chunk_tokens, e.min_chunk_tokens, e.max_segments_per_request
    )
    segments = explode_segments(segments_by_kind(files)).withColumn("cache_key", key)
    cache = _previous_table(spark, previous, "enriched", f"cache_key string, chunk {ENRICHED}")
    N.reuse_enrichment(segments, cache).write.parquet(f"{folder}/segments")
    stored = spark.read.parquet(f"{folder}/segments")
    hits, misses = stored.where("cached is not null"), stored.where("cached is null").drop("cached")

    requests = N.request_batches(misses, e.max_segments_per_request)
    N.call_enricher(requests, enricher).write.parquet(f"{folder}/answers")
    answered = N.answered_chunks(spark.read.parquet(f"{folder}/answers"))
    placed = N.placed_chunks(answered).unionByName(N.cached_chunks(hits))
    N.enrichment_cache(placed).write.parquet(f"{folder}/enriched")
    rows = N.explode_enriched(N.constrained(N.gather_files(placed), e.max_chunk_tokens, e.min_chunk_tokens))
    chunks = rows.select(
        F.col("id").alias("chunk_id"), "path", "ord", "text", sha256(F.col("text")).alias("hash"), "metadata"
    )

    before = _previous_table(spark, previous, "segments", "path string, source_hash string")
    known = stored.select("path", "source_hash").distinct().join(
        before.select("path", "source_hash").distinct(), ["path", "source_hash"], "left_semi"
    )
    counters = {
        "calls": answered.where("not fallback").count(),
        "file_cache_hits": known.count(),
        "segment_cache_hits": hits.count(),
    }
    return materialize(
        chunks,
        out,
        spec,
        embedder,
        previous=previous,
        run=run,
        extras={"enrichment": counters},
        extra_files={"segments": "segments", "enriched": "enriched"},
    )


def query_packet(
    spark: SparkSession,
    packet: str,
    queries: DataFrame,
    embedder: Embedder,
    k: int = 5,
    *,
    reranker: str = "none",
    fetch_k: int | None = None,
    metadata: dict[str, str] | None = None,
    indexer: str = "flat-ip",
    model: str | None = None,
) -> DataFrame:
    """``queries(query_id, text)`` to hits ``(query_id, rank, score, chunk_id, text, metadata)``.

    The reranker sees ``fetch_k`` hits (default ``k``); a metadata filter applies to its result.
    ``indexer`` names a registered search. Query vectors must have the packet's dimension, and
    ``model``, if given, must be the packet's.
    """
    rerank = S.pick(S.RERANKERS, reranker, "reranker")
    search = S.pick(S.INDEXERS, indexer, "indexer")
    manifest = P.read_manifest(spark, packet)
    if manifest is None:
        raise ValueError(f"no packet at {packet}")
    known = manifest["embedding"]
    if model is not None and model != known["model"]:
        raise ValueError(f"the packet was made with {known['model']!r}, not {model!r}")
    wanted = max(fetch_k or k, k, 1)
    wrong = F.concat(F.lit(f"the packet's vectors have {known['dim']} dimensions, the query's "), F.size("vec").cast("string"))
    asked = E.embed_texts(queries, embedder, key="query_id").withColumn(
        "vec", F.when(F.size("vec") == known["dim"], F.col("vec")).otherwise(F.raise_error(wrong))
    )
    # The embedder may be a paid service, and the hits are used more than once: both are stored first.
    by_hash = stored_once(search(P.table_of(spark, packet, manifest, "vectors"), stored_once(asked, "asked"), wanted), "hash-hits")
    hits = S.normalize_hits(S.packet_hits(by_hash, P.table_of(spark, packet, manifest, "docs"), wanted))
    ranked = rerank(hits, k)
    return S.filter_metadata(ranked, metadata) if metadata else ranked
