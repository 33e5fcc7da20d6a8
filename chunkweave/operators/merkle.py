"""Stored fingerprint trees, and drift that reads only what differs.

The files of a source tree fall into 16**3 buckets by the digest of their path. A bucket's fingerprint
covers the number of its files and eight sums over the digests of their ``path:digest`` lines, so it is
added up on the map side, and no task gathers a bucket. Every node above covers its up to sixteen
children, up to the root of the source tree.

``root/nodes`` has the nodes, in folders by depth and first digit; ``root/files`` the files, in folders
by the first digit, sorted by bucket. Two stores are compared from the roots down: each level is read
only below nodes that differ, and of the files only folders and row groups of buckets that differ.

A row without source tree or path is no file; a missing digest counts as an empty one. Of several rows
for one path all are covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.text import sha256
from chunkweave.operators.integrity import artifact_drift
from chunkweave.sources.tables import stored

DEPTH = 3
LANES = 8
NODES = "tree string, prefix string, n_files long, digest string, depth int, head string"
FILES = "tree string, path string, digest string, bucket string, branch string"


def _bucketed(files: DataFrame) -> DataFrame:
    kept = files.where(F.col("tree").isNotNull() & F.col("path").isNotNull())
    bucket = F.substring(sha256(F.col("path")), 1, DEPTH)
    return kept.select("tree", "path", F.coalesce("digest", F.lit("")).alias("digest"), bucket.alias("bucket"), F.concat(F.lit("h"), F.substring(bucket, 1, 1)).alias("branch"))


def _lane(digest: Column, number: int) -> Column:
    """Eight hexadecimal digits as a number; sums of a billion of them stay below 2**62."""
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def tree_nodes(files: DataFrame) -> DataFrame:
    """``(tree, prefix, n_files, digest)`` of all nodes over ``files(tree, path, digest)``: buckets have a
    prefix of three digits, roots an empty one."""
    lines = _bucketed(files).select("tree", F.col("bucket").alias("prefix"), sha256(F.concat_ws(":", "path", "digest")).alias("line"))
    sums = lines.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("n_files"), *[F.sum(_lane(F.col("line"), i)).alias(f"lane{i}") for i in range(LANES)]
    )
    level = sums.select("tree", "prefix", "n_files", sha256(F.concat_ws(":", "n_files", *[f"lane{i}" for i in range(LANES)])).alias("digest"))
    level = stored(level, "tree-buckets")
    found = level
    for depth in range(DEPTH - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "digest")))  # sixteen at most
        level = level.groupBy("tree", F.substring("prefix", 1, depth).alias("up")).agg(
            F.sum("n_files").alias("n_files"), sha256(F.array_join(children, "\n")).alias("digest")
        ).withColumnRenamed("up", "prefix")
        found = found.unionByName(level)
    return found


def write_tree(files: DataFrame, root: str) -> None:
    """Store the nodes and files of ``files(tree, path, digest)``. A source tree of any share of all files
    is dealt out by the digests of its paths."""
    rows = _bucketed(files)
    rows.repartition("branch", "bucket").sortWithinPartitions("branch", "bucket", "tree", "path").write.partitionBy("branch").parquet(f"{root}/files")
    nodes = tree_nodes(_files(files.sparkSession, root))
    placed = nodes.withColumn("depth", F.length("prefix")).withColumn("head", F.concat(F.lit("h"), F.substring("prefix", 1, 1)))
    placed.write.partitionBy("depth", "head").parquet(f"{root}/nodes")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{root}/files")


def _nodes(spark: SparkSession, root: str, depth: int) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{root}/nodes").where(F.col("depth") == depth)


def _unequal(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``(tree, prefix)`` of the expected nodes that are not the same in the actual ones."""
    now = actual.select("tree", "prefix", F.col("digest").alias("now"))
    return expected.join(now, ["tree", "prefix"], "left").where(~F.col("digest").eqNullSafe(F.col("now"))).select("tree", "prefix")


def tree_drift(spark: SparkSession, recorded: str, actual: str) -> DataFrame:
    """``(tree, path, expected, actual, problem)``: files of the store ``recorded`` that are missing in the
    store ``actual`` or differ there. Files only the latter has are ignored."""
    below = stored(_unequal(_nodes(spark, recorded, 0), _nodes(spark, actual, 0)), "tree-unequal")
    heads: list[str] = []
    for depth in range(1, DEPTH + 1):
        parents = below.select("tree", F.col("prefix").alias("parent"))

        def level(root, depth=depth, heads=tuple(heads), parents=parents):
            nodes = _nodes(spark, root, depth)
            nodes = nodes.where(F.col("head").isin(*heads)) if depth > 1 else nodes
            parent = F.substring("prefix", 1, depth - 1).alias("parent")
            return nodes.select("tree", "prefix", "digest", parent).join(parents, ["tree", "parent"], "left_semi")

        below = stored(_unequal(level(recorded), level(actual)), "tree-unequal")
        prefixes = sorted(r.prefix for r in below.select("prefix").distinct().collect())  # 16**3 at most
        heads = sorted({f"h{p[0]}" for p in prefixes})
    buckets = below.withColumnRenamed("prefix", "bucket")

    def files(root):
        own = _files(spark, root).where(F.col("branch").isin(*heads) & F.col("bucket").isin(*prefixes))
        return own.join(buckets, ["tree", "bucket"], "left_semi").select("tree", "path", "digest")

    return artifact_drift(files(recorded), files(actual), ["tree", "path"])
