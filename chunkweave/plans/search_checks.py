"""Registered queries: exact search, text search, reranking and hit shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.functions import vectors as V
from chunkweave.functions.text import safe_segment
from chunkweave.functions.wordbag import word_bag
from chunkweave.operators import embedding as E
from chunkweave.operators import search as S
from chunkweave.plans import inputs as In
from chunkweave.plans.build_checks import CHUNKED, DIM, chunks

K = 5


def _vectors(spark, folder):
    return In.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), F.col("label").alias("packet")
    )


def _as_queries(vectors):
    return vectors.select(F.col("chunk_id").alias("query_id"), "vec", "packet")


def topk_exact(spark, folder):
    """Every vector asked against all vectors."""
    vectors = _vectors(spark, folder)
    return S.top_k(vectors, _as_queries(vectors), K)


def topk_grid(spark, folder):
    """The same with more queries than one block holds."""
    vectors = _vectors(spark, folder)
    return S.top_k(vectors, _as_queries(vectors), K, query_bytes=256 * 64 * 8)


def topk_by_packet(spark, folder):
    """Every vector asked against the vectors of its own packet."""
    vectors = _vectors(spark, folder)
    return S.top_k(vectors, _as_queries(vectors), K, packet="packet")


def _packet(spark, folder):
    """Chunk table and one stored vector per distinct text."""
    table = chunks(spark, folder).withColumn("chunk_id", F.concat_ws(":", "path", "ord")).withColumn(
        "metadata", F.create_map(F.lit("path"), "path", F.lit("ext"), "ext", F.lit("lang"), "lang")
    )
    vectors = E.embed_texts(E.distinct_texts(table), word_bag(DIM)).withColumn("vec", V.half_precision(F.col("vec")))
    return table.select("chunk_id", "hash", "text", "metadata"), vectors


def _asked(spark, folder):
    items = In.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return E.embed_texts(items, word_bag(DIM), key="query_id")


def hits(spark, folder):
    table, vectors = _packet(spark, folder)
    by_hash, few = S.top_k_bounded(vectors, _asked(spark, folder), K, key="hash")
    return S.normalize_hits(S.chunk_hits(by_hash, table, K, few))


def text_query(spark, folder):
    return hits(spark, folder).select("query_id", "rank", "chunk_id", "score")


def metadata_filter(spark, folder):
    kept = S.filter_metadata(hits(spark, folder), {"lang": "en"})
    return kept.select("query_id", "rank", "chunk_id", F.col("metadata")["ext"].alias("ext"))


def display_hits(spark, folder):
    return S.display_hits(hits(spark, folder))


def rerank_none(spark, folder):
    return S.pick(S.RERANKERS, "none", "reranker")(hits(spark, folder), 3).select("query_id", "rank", "chunk_id")


def rerank_diversity(spark, folder):
    rerank = S.pick(S.RERANKERS, "token-diversity", "reranker")
    return rerank(hits(spark, folder), K).select("query_id", "rank", "chunk_id", "score")


def labelled_hits(spark, folder):
    """Hits of every document's own vector space neighbour joined to labels as metadata."""
    vectors = _vectors(spark, folder)
    found = S.top_k(vectors, _as_queries(vectors), K)
    labels = In.table(spark, folder, "labels").select(
        F.col("doc_id").alias("chunk_id"),
        F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")).alias("metadata"),
    )
    joined = found.join(labels, "chunk_id", "left").withColumn("text", F.lit(None).cast("string"))
    return S.filter_metadata(S.normalize_hits(joined), {"quality": "1"}).select("query_id", "rank", "chunk_id", "score")


def safe_segments(spark, folder):
    pages = In.table(spark, folder, "pages")
    return pages.select("page_id", safe_segment(F.col("url")).alias("segment"))


DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE)))"


def _sql_topk(on: str) -> str:
    return f"""
WITH scored AS (
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DOT} AS dot FROM embeddings q JOIN embeddings v ON {on}),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 10) DESC, chunk_id) AS INTEGER) AS rank, chunk_id,
           round(dot, 6) + 0.0 AS score
    FROM scored QUALIFY rank <= {K})
"""


HITS = (
    CHUNKED
    + ", all_texts AS (SELECT hash, any_value(text) AS text FROM chunks GROUP BY hash),"
    + In.sql_bag("bag", "all_texts", "hash", DIM)
    + ","
    + In.sql_bag("asked", "benchmark", "item_id", DIM)
    + f""",
scored AS (
    SELECT item_id, hash, sum(CAST(a.value AS DOUBLE) * {In.sql_half('b.value')}) AS score
    FROM asked a JOIN bag b USING (slot) GROUP BY item_id, hash),
all_scored AS (
    SELECT b.item_id, h.hash, round(coalesce(score, 0), 6) + 0.0 AS score, round(coalesce(score, 0), 10) AS compared
    FROM benchmark b CROSS JOIN (SELECT hash FROM all_texts) h LEFT JOIN scored s ON s.item_id = b.item_id AND s.hash = h.hash),
hits AS (
    SELECT item_id AS query_id, path || ':' || ord AS chunk_id, path, ext, lang, text, score,
           CAST(row_number() OVER (PARTITION BY item_id ORDER BY compared DESC, path || ':' || ord) AS INTEGER) AS rank
    FROM all_scored JOIN chunks USING (hash) QUALIFY rank <= {K})
"""
)

QUERIES = {
    "topk_exact": (topk_exact, _sql_topk("true") + "SELECT * FROM ranked"),
    "topk_grid": (topk_grid, _sql_topk("true") + "SELECT * FROM ranked"),
    "topk_by_packet": (topk_by_packet, _sql_topk("q.label = v.label") + "SELECT * FROM ranked"),
    "text_query": (text_query, HITS + "SELECT query_id, rank, chunk_id, score FROM hits"),
    "metadata_filter": (metadata_filter, HITS + "SELECT query_id, rank, chunk_id, ext FROM hits WHERE lang = 'en'"),
    "display_hits": (
        display_hits,
        HITS
        + f""", lined AS (SELECT *, {In.sql_strip("replace(text, chr(10), ' ')")} AS t FROM hits)
        SELECT query_id, rank, format('{{:.4f}}', round(score, 4)) AS score_text, chunk_id, path,
        CASE WHEN length(t) > 160 THEN substr(t, 1, 157) || '...' ELSE t END AS line FROM lined""",
    ),
    "rerank_none": (rerank_none, HITS + "SELECT query_id, rank, chunk_id FROM hits WHERE rank <= 3"),
    "rerank_diversity": (
        rerank_diversity,
        HITS.replace("WITH", "WITH RECURSIVE", 1)
        + f""", words AS (SELECT *, list_distinct(list_filter({In.sql_words('lower(text)')}, lambda w: length(w) > 3)) AS tokens FROM hits),
        picks AS (
            SELECT DISTINCT query_id, 0 AS rank, 0 AS chosen, []::VARCHAR[] AS seen, false AS taken FROM hits
            UNION ALL
            SELECT query_id, rank, CASE WHEN takes THEN chosen + 1 ELSE chosen END, CASE WHEN takes THEN list_concat(seen, tokens) ELSE seen END, takes
            FROM (SELECT p.query_id, w.rank, p.chosen, p.seen, w.tokens,
                         p.chosen < {K} AND (p.chosen = 0 OR len(list_filter(w.tokens, lambda t: NOT list_contains(p.seen, t))) > 0 OR p.chosen < {K // 2}) AS takes
                  FROM picks p JOIN words w ON w.query_id = p.query_id AND w.rank = p.rank + 1) x)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY taken DESC, rank) AS INTEGER) AS rank, chunk_id, score
        FROM picks JOIN hits USING (query_id, rank) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY taken DESC, rank) <= {K}""",
    ),
    "labelled_hits": (
        labelled_hits,
        _sql_topk("true")
        + "SELECT query_id, rank, chunk_id, score FROM ranked JOIN labels ON doc_id = chunk_id WHERE quality = 1",
    ),
    "safe_segments": (
        safe_segments,
        r"""SELECT page_id, trim(regexp_replace(translate(url, '\/', '--'), '[^a-zA-Z0-9._\-+@]+', '-', 'g'), '-') AS segment FROM pages""",
    ),
}
