"""Registered queries: what jobs have stored, read back - packets, source trees, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chunkweave.functions.text import sha256
from chunkweave.functions.wordbag import word_bag
from chunkweave.operators import catalogue as C
from chunkweave.operators import merkle as M
from chunkweave.plans import build as B
from chunkweave.plans import catalogue_checks as V
from chunkweave.plans import inputs as In
from chunkweave.plans.build_checks import BOTH, CHUNKED, OVERLAP, WIDTH, files
from chunkweave.plans.build_checks import DIM as SEARCH_DIM
from chunkweave.plans.catalogue_checks import VERSIONS
from chunkweave.plans.search_checks import HITS, K
from chunkweave.session import shared_folder
from chunkweave.sources import packets as P
from chunkweave.sources import versioned as T
from chunkweave.sources.files import scan_files
from chunkweave.sources.tables import stored as stored_once
from chunkweave.streaming.incremental import current_chunks, ingest_stream

SPEC = B.PacketSpec("checks", "1.0", "bag", lines_per_chunk=WIDTH, overlap_lines=OVERLAP)
DIM, OTHER_DIM = 16, 8


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def packet_rebuild(spark, folder):
    """The earlier build's packet, rebuilt in place from the files of now; every chunk with whether it
    has a vector of the right width, and whether that was there before."""
    packet, now = _folder(spark, "packet"), files(spark, folder)
    B.build_packet(In.earlier(now), packet, SPEC, word_bag(DIM))
    before = P.packet_table(spark, packet, "vectors").select("hash", F.lit(True).alias("before"))
    B.build_packet(now, packet, SPEC, word_bag(DIM), previous=packet)
    vectors = P.packet_table(spark, packet, "vectors").select("hash", (F.size("vec") == DIM).alias("complete"))
    chunks = P.packet_table(spark, packet, "docs").join(vectors, "hash", "left").join(before, "hash", "left")
    return chunks.select("path", "ord", "hash", F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("before", F.lit(False)).alias("reused"))


def packet_reembed(spark, folder):
    """A packet embedded again in place with another model: one vector per distinct text, of its width."""
    packet = _folder(spark, "packet")
    B.build_packet(files(spark, folder), packet, SPEC, word_bag(DIM))
    B.reembed_packet(spark, packet, packet, B.PacketSpec("checks", "1.1", "other"), word_bag(OTHER_DIM))
    return P.packet_table(spark, packet, "vectors").select("hash", F.size("vec").alias("dim"))


def packet_query(spark, folder):
    """The benchmark's texts asked of a packet that was built from the files."""
    packet = _folder(spark, "packet")
    B.build_packet(files(spark, folder), packet, SPEC, word_bag(SEARCH_DIM))
    items = In.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return B.query_packet(spark, packet, items, word_bag(SEARCH_DIM), K).select("query_id", "rank", "chunk_id", "score")


def tree_scan(spark, folder):
    """Documents written as text files, a folder per source, and the tree scanned."""
    root = _folder(spark, "tree")
    docs = In.table(spark, folder, "documents")
    docs.select("source", F.replace("text", F.lit("\r"), F.lit(" ")).alias("value")).repartition("source").write.partitionBy("source").text(root)
    found = scan_files(spark, root, [".txt"])
    return found.groupBy(F.regexp_extract("path", "^source=([^/]+)/part-[^/]+[.]txt$", 1).alias("source")).agg(
        F.sum("size").alias("bytes"), F.sum(F.length(F.decode("raw", "UTF-8"))).cast("long").alias("n_chars")
    )


def stream_ingest(spark, folder):
    """Two batches of arriving files, the second one edited: the chunks that are current afterwards."""
    out, inbox = _folder(spark, "stream"), _folder(spark, "inbox")
    now = stored_once(files(spark, folder).select("path", "ext", "lang", "content"), "arriving")
    for rows in (In.earlier(now), now):
        rows.select("path", "ext", "content").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("path string, ext string, content string").parquet(inbox)
        ingest_stream(stream, out, SPEC, word_bag(DIM), f"{out}-state").awaitTermination()
    vectors = spark.read.parquet(f"{out}/vectors").groupBy("hash").agg(F.count(F.lit(1)).alias("vectors"))
    return current_chunks(spark, out).join(vectors, "hash", "left").select("path", "ord", "hash", "vectors")


def _tree(files):
    return files.select(F.col("source").alias("tree"), "path", sha256(F.col("content")).alias("digest"))


def tree_nodes(spark, folder):
    """All nodes of the stored fingerprint trees of the sources."""
    root = _folder(spark, "nodes")
    M.write_tree(_tree(In.sources(spark, folder)), root)
    return spark.read.schema(M.NODES).parquet(f"{root}/nodes").select("tree", "prefix", "n_files", "digest")


def tree_drift(spark, folder):
    """Stored trees of the earlier build and of now, where scripts have gone missing, compared from the roots down."""
    before, after = _folder(spark, "tree-before"), _folder(spark, "tree-after")
    now = In.sources(spark, folder)
    M.write_tree(_tree(In.earlier(now)), before)
    M.write_tree(_tree(now.where(F.col("ext") != ".sh")), after)
    return M.tree_drift(spark, before, after)


def catalogue_store(spark, folder):
    """A stored catalogue: later versions are published into the earlier ones, one version of each package
    is made active, old versions are pruned; then the tables are read back. Every step is a change of the
    newest version of its table that concurrent writers would survive."""
    root, rows, first_pins = _folder(spark, "catalogue"), V.versions(spark, folder), V.pins(spark, folder)
    early = F.col("published_at") < F.to_timestamp(F.lit("1998-01-01"))

    def changed(name, schema, change):
        T.change_table(spark, f"{root}/{name}", schema, change)
        return T.read_version(spark, f"{root}/{name}", schema)

    changed("versions", rows.schema, lambda _: rows.where(early))
    changed("pins", first_pins.schema, lambda _: first_pins)
    later = rows.where(~early).withColumnRenamed("id", "upload_id")
    stored = changed("versions", rows.schema, lambda known: C.published(known, later))
    latest = stored.select(F.concat("name", F.lit("@latest")).alias("spec")).distinct()
    pins = changed("pins", first_pins.schema, lambda known: C.use(known, latest, stored))
    left = changed("versions", rows.schema, lambda known: C.delete_versions(known, C.prune_plan(known, pins, keep=1)))
    return left.select("name", "version").distinct().join(pins, "name", "left")


LANE_SUMS = ", ".join(f"CAST(sum(CAST('0x' || substr(line, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT)" for i in range(M.LANES))
UPPER = ", ".join(
    f"""n{d} AS (SELECT tree, substr(prefix, 1, {d}) AS prefix, CAST(sum(n_files) AS BIGINT) AS n_files,
        sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest FROM n{d + 1} GROUP BY ALL)"""
    for d in range(M.DEPTH - 1, -1, -1)
)

QUERIES = {
    "tree_nodes": (
        tree_nodes,
        f"""WITH {In.SOURCES}, lines AS (SELECT source AS tree, substr(sha256(path), 1, {M.DEPTH}) AS prefix, sha256(path || ':' || sha256(content)) AS line FROM sources),
        n{M.DEPTH} AS (SELECT tree, prefix, count(*) AS n_files, sha256(concat_ws(':', count(*), {LANE_SUMS})) AS digest FROM lines GROUP BY tree, prefix),
        {UPPER} {" UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(M.DEPTH + 1))}""",
    ),
    "tree_drift": (
        tree_drift,
        f"""WITH {In.SOURCES}, {In.EARLIER}
        SELECT e.source AS tree, e.path, sha256(e.content) AS expected, CASE WHEN e.ext <> '.sh' THEN sha256(s.content) END AS actual,
               CASE WHEN e.ext = '.sh' THEN 'missing' ELSE 'mismatch' END AS problem
        FROM earlier e JOIN sources s USING (path) WHERE e.ext = '.sh' OR e.content <> s.content""",
    ),
    "catalogue_store": (
        catalogue_store,
        VERSIONS
        + """, old AS (SELECT DISTINCT name, version FROM versions WHERE published_at < TIMESTAMP '1998-01-01'),
        later AS (SELECT DISTINCT name, version FROM versions WHERE published_at >= TIMESTAMP '1998-01-01' AND size_bytes > 0),
        listed AS (SELECT k.* FROM known k JOIN (SELECT * FROM old UNION SELECT * FROM later) USING (name, version)),
        newest AS (SELECT name, arg_max(version, vkey) AS version FROM listed GROUP BY name),
        held AS (SELECT p.name, p.pinned, coalesce(n.version, p.active) AS active FROM pins p LEFT JOIN newest n USING (name))
        SELECT l.name, l.version, pinned, active FROM listed l JOIN held h USING (name) WHERE l.version IN (pinned, active)""",
    ),
    "packet_rebuild": (
        packet_rebuild,
        BOTH + "SELECT path, ord, hash, true AS complete, hash IN (SELECT hash FROM old_chunks) AS reused FROM chunks",
    ),
    "packet_query": (packet_query, HITS + "SELECT query_id, rank, chunk_id, score FROM hits"),
    "packet_reembed": (packet_reembed, CHUNKED + f"SELECT DISTINCT hash, {OTHER_DIM} AS dim FROM chunks"),
    "tree_scan": (
        tree_scan,
        """SELECT source, CAST(sum(strlen(replace(text, chr(13), ' ')) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
           FROM documents GROUP BY source""",
    ),
    "stream_ingest": (stream_ingest, CHUNKED + "SELECT path, ord, hash, CAST(1 AS BIGINT) AS vectors FROM chunks"),
}
