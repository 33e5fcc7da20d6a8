"""Fingerprints of files and trees, drift against recorded fingerprints, packet counts, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.text import path_parts, sha256

BUCKET_HEX = 3

# Tag by extension.
EXTENSION_TAGS = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".kt": "kotlin",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp",
    ".c": "cpp",
    ".h": "cpp",
    ".cs": "csharp",
    ".md": "docs",
    ".rst": "docs",
    ".txt": "docs",
}


def extension_counts(files: DataFrame) -> DataFrame:
    """Non-blank files per extension."""
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def infer_tags(counts: DataFrame, fixed_tag: str) -> DataFrame:
    """One row: the sorted tags of the extensions present, and the fixed tag.

    At most one row per known extension is collected.
    """
    tag = F.create_map(*[F.lit(x) for pair in EXTENSION_TAGS.items() for x in pair])
    named = counts.where(F.col("files") > 0).select(F.try_element_at(tag, F.col("ext")).alias("tag"))
    return named.where(F.col("tag").isNotNull()).agg(
        F.array_sort(F.array_union(F.collect_set("tag"), F.array(F.lit(fixed_tag)))).alias("tags")
    )


def packet_counts(chunks: DataFrame, vectors: DataFrame, packet: str = "packet") -> DataFrame:
    """Docs and vectors per packet and whether they agree."""
    docs = chunks.groupBy(packet).agg(F.count(F.lit(1)).alias("docs"))
    vecs = vectors.groupBy(packet).agg(F.count(F.lit(1)).alias("vectors"))
    return (
        docs.join(vecs, packet, "full_outer")
        .na.fill(0, ["docs", "vectors"])
        .withColumn("consistent", F.col("docs") == F.col("vectors"))
    )


def checksums(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", F.sha2(F.col(content), 256).alias("digest"))


def _lines(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: e["line"]), "\n")


def tree_fingerprints(files: DataFrame, tree: str = "tree", scheme: str = "bucketed") -> DataFrame:
    """One fingerprint per tree of ``(tree, path, digest)`` rows.

    The scheme does not depend on the size of a tree. ``bucketed`` hashes in two levels: files fall
    into buckets by the digest of their path, and the tree's fingerprint covers the at most
    16**BUCKET_HEX bucket lines, so no task sees a whole tree. ``flat`` is the digest of all
    ``path:digest`` lines in path order, for exchange with tools that record it; it gathers each tree
    in one task. Either changes exactly when a path or a digest changes.
    """
    entry = F.struct(path_parts(F.col("path")).alias("key"), F.concat_ws(":", "path", "digest").alias("line"))
    listed = F.array_sort(F.collect_list(entry)).alias("entries")
    if scheme == "flat":
        whole = files.groupBy(tree).agg(F.count(F.lit(1)).alias("n_files"), listed)
    elif scheme == "bucketed":
        bucket = F.substring(sha256(F.col("path")), 1, BUCKET_HEX).alias("bucket")
        buckets = files.groupBy(tree, bucket).agg(F.count(F.lit(1)).alias("rows"), listed)
        lines = buckets.select(tree, "rows", F.struct("bucket", F.concat_ws(":", "bucket", sha256(_lines(F.col("entries")))).alias("line")).alias("entry"))
        whole = lines.groupBy(tree).agg(F.sum("rows").alias("n_files"), F.array_sort(F.collect_list("entry")).alias("entries"))
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return whole.select(tree, "n_files", F.lit(scheme).alias("scheme"), sha256(_lines(F.col("entries"))).alias("fingerprint"))


def artifact_drift(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded fingerprints that are missing or differ now. Files nobody recorded are ignored."""
    now = actual.select(*keys, F.col("digest").alias("actual"))
    return (
        expected.select(*keys, F.col("digest").alias("expected"))
        .join(now, keys, "left")
        .withColumn(
            "problem",
            F.when(F.col("actual").isNull(), F.lit("missing")).when(F.col("actual") != F.col("expected"), F.lit("mismatch")),
        )
        .where(F.col("problem").isNotNull())
    )


def plan_drift(recorded: DataFrame, planned: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per field in which a recorded plan and the current one differ (nulls compare equal)."""
    left = recorded.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("recorded"))
    right = planned.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("planned"))
    checks = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"planned.{f}").alias("expected"),
                F.col(f"recorded.{f}").alias("got"),
            )
            for f in fields
        ]
    )
    both = right.join(left, keys, "left").select(
        *keys, F.explode(F.filter(checks, lambda c: ~c["expected"].eqNullSafe(c["got"]))).alias("check")
    )
    return both.select(*keys, "check.*")
