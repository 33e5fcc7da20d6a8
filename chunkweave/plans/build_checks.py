"""Registered queries: scanning, line windows, incremental embedding, vector checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions import vectors as V
from chunkweave.functions.text import char_estimate, is_blank, sha256, word_count
from chunkweave.functions.wordbag import word_bag
from chunkweave.operators import embedding as E
from chunkweave.operators import integrity as I
from chunkweave.operators import windows as W
from chunkweave.operators.skew import spread_join
from chunkweave.plans import inputs as In
from chunkweave.sources.files import CODE_EXTENSIONS, TEXT_EXTENSIONS, decode_text
from chunkweave.sources.tables import new_folder, read_by_hash, stored, write_by_hash

WIDTH, OVERLAP, DIM = 12, 3, 32
ALLOWED = CODE_EXTENSIONS + TEXT_EXTENSIONS
SQL_ALLOWED = f"({', '.join(In.text_literal(e) for e in ALLOWED)})"

# The allowed, non-blank files, as a build sees them.
BUILD = f"""
WITH {In.SOURCES}, {In.EARLIER},
files AS (SELECT * FROM sources WHERE ext IN {SQL_ALLOWED} AND {In.sql_strip('content')} <> ''),
old_files AS (SELECT * FROM earlier WHERE ext IN {SQL_ALLOWED} AND {In.sql_strip('content')} <> '')
"""
CHUNKED = BUILD + "," + In.sql_chunks("chunks", "files", WIDTH, OVERLAP)
BOTH = CHUNKED + "," + In.sql_chunks("old_chunks", "old_files", WIDTH, OVERLAP)


def files(spark: SparkSession, folder: str) -> DataFrame:
    found = In.sources(spark, folder)
    return found.where(F.col("ext").isin(*ALLOWED) & ~is_blank(F.col("content")))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Blank windows are dropped anyway, so blank files need no filter of their own here."""
    allowed = In.sources(spark, folder).where(F.col("ext").isin(*ALLOWED))
    return E.with_hash(W.line_chunks(allowed, WIDTH, OVERLAP))


def old_chunks(spark: SparkSession, folder: str) -> DataFrame:
    allowed = In.sources(spark, folder).where(F.col("ext").isin(*ALLOWED))
    return E.with_hash(W.line_chunks(In.earlier(allowed), WIDTH, OVERLAP))


def old_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier build's vectors by hash."""
    old = old_chunks(spark, folder)
    return E.embed_texts(E.distinct_texts(old), word_bag(DIM)).withColumn("vec", V.half_precision(F.col("vec")))


def source_scan(spark, folder):
    return files(spark, folder).select(
        "path", "ext", F.length("content").alias("n_chars"), sha256(F.col("content")).alias("digest")
    )


def decode_bytes(spark, folder):
    """Texts stored as bytes in one of two encodings, read back."""
    docs = In.table(spark, folder, "documents")
    latin = F.col("text").rlike(r"^[\x00-\xff]*$") & F.col("lang").isin("fr", "de", "es")
    stored = docs.withColumn(
        "content", F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    )
    return stored.select("doc_id", sha256(decode_text(F.col("content"))).alias("digest"))


def ext_counts(spark, folder):
    return I.extension_counts(files(spark, folder))


def files_indexed(spark, folder):
    found = In.sources(spark, folder).where(F.col("ext").isin(*ALLOWED))
    return found.agg(
        F.count(F.lit(1)).alias("files_indexed"), F.count_if(is_blank(F.col("content"))).alias("blank_files")
    )


def infer_tags(spark, folder):
    tags = I.infer_tags(I.extension_counts(files(spark, folder)), "corpus")
    return tags.select(F.array_join("tags", ",").alias("tags"))


def line_chunks(spark, folder):
    return chunks(spark, folder).select("path", "ord", "hash", F.length("text").alias("n_chars"))


def chunk_ids(spark, folder):
    n_files = In.table(spark, folder, "documents").count()
    return W.number_chunks(chunks(spark, folder), n_files=n_files).select("path", "ord", "number", "id", "hash")


def chunk_ids_ranged(spark, folder):
    return W.number_chunks(chunks(spark, folder), ranges=16).select("path", "ord", "number", "id", "hash")


def token_counts(spark, folder):
    docs = In.table(spark, folder, "documents")
    return docs.select(
        "doc_id", word_count(F.col("text")).alias("words"), char_estimate(F.col("text")).alias("estimate")
    )


def cache_first_wins(spark, folder):
    old = W.number_chunks(old_chunks(spark, folder))
    marked = old.select("hash", F.col("number").alias("ord"), F.col("id").alias("vec"))
    return E.first_by_hash(marked).select("hash", F.col("vec").alias("first_id"))


def stored_cache(spark, folder):
    """The hashes of the earlier build, laid out by hash as a packet's vectors are."""
    path, buckets = new_folder(spark, "cache"), spark.sparkContext.defaultParallelism
    write_by_hash(old_chunks(spark, folder).select("hash").distinct(), path, "hash", buckets)
    return read_by_hash(spark, path, "hash string", "hash", buckets)


def cache_reuse(spark, folder):
    """Every chunk with whether its vector is known. The cache stays as it lies, hot hashes stay too."""
    known = stored_cache(spark, folder).withColumn("known", F.lit(True))
    rows = stored(chunks(spark, folder).select("path", "ord", "hash"), "cache-chunks")
    return spread_join(rows, known, "hash").select("path", "ord", "hash", F.col("known").isNotNull().alias("reused"))


def to_embed(spark, folder):
    cache = old_chunks(spark, folder).select("hash").distinct()
    return E.missing_texts(chunks(spark, folder), cache, ["path", "ord"]).select("hash", F.length("text").alias("n_chars"))


def reused_chunks(spark, folder):
    cache = old_chunks(spark, folder).select("hash").distinct()
    return chunks(spark, folder).select("path", "ord", "hash").join(cache, "hash", "left_semi")


def removed_hashes(spark, folder):
    return E.removed_hashes(chunks(spark, folder), old_chunks(spark, folder))


def reuse_counts(spark, folder):
    return E.reuse_counts(chunks(spark, folder), old_chunks(spark, folder))


def incremental_embed(spark, folder):
    vectors = E.incremental_vectors(
        chunks(spark, folder), old_cache(spark, folder), word_bag(DIM), key=["path", "ord"]
    )
    return vectors.select(
        "hash",
        "reused",
        F.size("vec").alias("dim"),
        *[F.round(F.get("vec", F.lit(i)).cast("double"), 6).alias(f"v{i}") for i in range(4)],
        F.round(
            F.aggregate(
                F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x
            ),
            4,
        ).alias("weighted"),
    )


def _embeddings(spark, folder):
    return In.table(spark, folder, "embeddings").withColumnRenamed("embedding", "vec")


def l2_normalize(spark, folder):
    scaled = _embeddings(spark, folder).withColumn(
        "vec", F.transform("vec", lambda x: x * F.col("label").cast("double"))
    )
    unit = V.l2_normalize(F.col("vec"))
    return scaled.select(
        "vec_id",
        F.round(V.norm(F.col("vec")), 5).alias("length"),
        F.round(V.norm(unit), 5).alias("unit_length"),
        (F.round(F.get(unit, F.lit(0)), 5) + 0.0).alias("first"),
    )


def unit_check(spark, folder):
    scaled = _embeddings(spark, folder).withColumn(
        "vec", F.transform("vec", lambda x: x * F.least(F.col("label").cast("double"), F.lit(1.0)))
    )
    return E.unit_check(scaled)


def vector_violations(spark, folder):
    bad = _embeddings(spark, folder).withColumn(
        "vec",
        F.when(F.col("label") == 1, F.slice("vec", 1, 63))
        .when(F.col("label") == 2, F.concat(F.slice("vec", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .when(F.col("label") == 3, F.slice("vec", 1, 0))
        .otherwise(F.col("vec")),
    )
    return E.vector_violations(bad, 64).select("vec_id", "problem")


def quantize_half(spark, folder):
    return _embeddings(spark, folder).select(
        "vec_id", F.posexplode(V.half_precision(F.col("vec"))).alias("pos", "value")
    ).select("vec_id", "pos", F.col("value").cast("double").alias("value"))


def vector_shape(spark, folder):
    return E.vector_shape(_embeddings(spark, folder))


def response_order(spark, folder):
    """Responses as JSON documents with their items in reverse; some with a wrong index."""
    rows = _embeddings(spark, folder)
    items = F.transform(
        F.reverse(F.transform("vec", lambda x, i: F.struct(i.alias("index"), x.cast("double").alias("value")))),
        lambda e: F.struct(
            (e["index"] + F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0))).alias("index"),
            F.array(e["value"]).alias("embedding"),
        ),
    )
    raw = rows.select("vec_id", F.to_json(F.struct(items.alias("data"))).alias("raw"))
    parsed = raw.withColumn("data", F.from_json("raw", E.RESPONSE)["data"])
    ordered = E.ordered_response(F.col("data"))
    return parsed.select(
        "vec_id",
        ordered.isNotNull().alias("contiguous"),
        F.round(F.get(F.get(ordered, F.lit(0)), F.lit(0)), 6).alias("first"),
        F.round(F.get(F.get(ordered, F.lit(63)), F.lit(0)), 6).alias("last"),
    )


def provider_keys(spark, folder):
    docs = In.table(spark, folder, "documents")
    return docs.select("doc_id", E.provider_key(F.col("source"), F.col("text")).alias("cache_key"))


def path_order(spark, folder):
    """Position of every file in path order (by component, not by string)."""
    per_file = In.sources(spark, folder).select("path", F.lit(1).alias("n_chunks"))
    return W.first_numbers(per_file).select("path", F.col("first_number").alias("position"))


SQL_BAG = (
    BOTH
    + ", all_texts AS (SELECT hash, any_value(text) AS text FROM chunks GROUP BY hash),"
    + In.sql_bag("bag", "all_texts", "hash", DIM)
)

QUERIES = {
    "source_scan": (source_scan, BUILD + "SELECT path, ext, length(content) AS n_chars, sha256(content) AS digest FROM files"),
    "decode_bytes": (decode_bytes, "SELECT doc_id, sha256(text) AS digest FROM documents"),
    "ext_counts": (ext_counts, BUILD + "SELECT ext, count(*) AS files FROM files GROUP BY ext"),
    "files_indexed": (
        files_indexed,
        f"WITH {In.SOURCES} SELECT count(*) AS files_indexed, count(*) FILTER ({In.sql_strip('content')} = '') AS blank_files "
        f"FROM sources WHERE ext IN {SQL_ALLOWED}",
    ),
    "infer_tags": (
        infer_tags,
        BUILD
        + f"""SELECT string_agg(tag, ',' ORDER BY tag) AS tags FROM (
            SELECT DISTINCT map {{{', '.join(f"'{k}': '{v}'" for k, v in I.EXTENSION_TAGS.items())}}}[ext] AS tag FROM files
            UNION SELECT 'corpus')""",
    ),
    "line_chunks": (line_chunks, CHUNKED + "SELECT path, ord, hash, length(text) AS n_chars FROM chunks"),
    "chunk_ids": (
        chunk_ids,
        CHUNKED
        + """SELECT path, ord, number, path || ':' || number AS id, hash FROM (
            SELECT path, ord, hash, row_number() OVER (ORDER BY string_split(path, '/'), ord) - 1 AS number FROM chunks)""",
    ),
    "path_order": (
        path_order,
        f"WITH {In.SOURCES} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS position FROM sources",
    ),
    "token_counts": (
        token_counts,
        f"""SELECT doc_id, {In.sql_word_count('text')} AS words,
            CASE WHEN {In.sql_strip('text')} = '' THEN 0 ELSE greatest(1, length({In.sql_strip('text')}) // 4) END AS estimate
            FROM documents""",
    ),
    "cache_first_wins": (
        cache_first_wins,
        BOTH
        + """SELECT hash, arg_min(path || ':' || number, number) AS first_id FROM (
            SELECT path, hash, row_number() OVER (ORDER BY string_split(path, '/'), ord) - 1 AS number FROM old_chunks)
            GROUP BY hash""",
    ),
    "cache_reuse": (
        cache_reuse,
        BOTH + "SELECT path, ord, hash, hash IN (SELECT hash FROM old_chunks) AS reused FROM chunks",
    ),
    "to_embed": (
        to_embed,
        BOTH + "SELECT hash, length(any_value(text)) AS n_chars FROM chunks WHERE hash NOT IN (SELECT hash FROM old_chunks) GROUP BY hash",
    ),
    "reused_chunks": (
        reused_chunks,
        BOTH + "SELECT path, ord, hash FROM chunks WHERE hash IN (SELECT hash FROM old_chunks)",
    ),
    "removed_hashes": (
        removed_hashes,
        BOTH + "SELECT hash FROM old_chunks EXCEPT SELECT hash FROM chunks",
    ),
    "reuse_counts": (
        reuse_counts,
        BOTH
        + """SELECT count(*) AS new_chunks, count(*) FILTER (hash IN (SELECT hash FROM old_chunks)) AS reused,
            count(*) FILTER (hash NOT IN (SELECT hash FROM old_chunks)) AS to_embed,
            (SELECT count(*) FROM (SELECT hash FROM old_chunks EXCEPT SELECT hash FROM chunks)) AS removed FROM chunks""",
    ),
    "incremental_embed": (
        incremental_embed,
        SQL_BAG
        + f"""SELECT hash, hash IN (SELECT hash FROM old_chunks) AS reused, {DIM} AS dim,
            {', '.join(f"coalesce(round(sum(CASE WHEN slot = {i} THEN half END), 6), 0.0) AS v{i}" for i in range(4))},
            round(coalesce(sum(half * (slot + 1)), 0.0), 4) AS weighted
            FROM (SELECT DISTINCT hash FROM chunks) LEFT JOIN (SELECT *, {In.sql_half('value')} AS half FROM bag) USING (hash)
            GROUP BY hash""",
    ),
    "l2_normalize": (
        l2_normalize,
        """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label) AS v FROM embeddings),
            n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM s)
            SELECT vec_id, round(len, 5) AS length, CASE WHEN len > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS unit_length,
            round(CASE WHEN len > 0 THEN v[1] / len ELSE v[1] END, 5) + 0.0 AS first FROM n""",
    ),
    "unit_check": (
        unit_check,
        "SELECT count(*) AS vectors, count(*) FILTER (label = 0) AS zero_vectors, true AS is_normalized FROM embeddings",
    ),
    "vector_violations": (
        vector_violations,
        """SELECT vec_id, CASE label WHEN 1 THEN 'dimension' WHEN 2 THEN 'non_finite' ELSE 'empty' END AS problem
            FROM embeddings WHERE label IN (1, 2, 3)""",
    ),
    "quantize_half": (
        quantize_half,
        f"""SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, CAST({In.sql_half('x')} AS DOUBLE) AS value FROM (
            SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
    ),
    "vector_shape": (
        vector_shape,
        "SELECT count(*) AS vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings",
    ),
    "response_order": (
        response_order,
        """SELECT vec_id, label <> 0 AS contiguous, CASE WHEN label <> 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS first,
            CASE WHEN label <> 0 THEN round(CAST(embedding[64] AS DOUBLE), 6) END AS last FROM embeddings""",
    ),
    "provider_keys": (provider_keys, "SELECT doc_id, sha256(source || '|' || text) AS cache_key FROM documents"),
}
QUERIES["chunk_ids_ranged"] = (chunk_ids_ranged, QUERIES["chunk_ids"][1])
