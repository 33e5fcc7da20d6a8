"""Stored tables: chunks, vectors, manifests, descriptors and catalogue tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.text import sha256, split_lines, strip
from chunkweave.functions.vectors import half_precision
from chunkweave.session import shared_folder



def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to the shared folder and read from there: neither computed again nor lost
    with an executor."""
    folder = new_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


BYTES_PER_CORE = 32 * 1024 * 1024


def spread_small(table: DataFrame) -> DataFrame:
    """Give every core a part of a small input that sits in one file split.

    Per-document work is heavy, and a small file may be a single split. Above ``BYTES_PER_CORE`` per
    core the splits of the files are enough and nothing is moved, so the shuffle this adds is bounded.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size < cores * BYTES_PER_CORE else table


DENSE_BYTES = 4 * 1024 * 1024


def spread_dense(table: DataFrame) -> DataFrame:
    """A table of short rows in tasks of at most ``DENSE_BYTES`` of its files, and one per core at least: stored in some
    ten bytes a row, a usual file split is many millions of rows, which sorts with keys made of them would hold at once."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-size // DENSE_BYTES)))


CHUNK_SCHEMA = "id string, text string, hash string, metadata map<string,string>"


def read_chunk_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Chunks from JSON lines; blank lines are skipped.

    A malformed line stops a strict read and is left out of a lenient one. Chunks are joined to
    vectors by hash, so a line left out shifts nothing.
    """
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(CHUNK_SCHEMA).option("mode", mode).json(path)


def write_chunk_lines(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines with their content hash."""
    rows = chunks.withColumn("hash", sha256(F.col("text")))
    rows.select("id", "text", "hash", "metadata").write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str, key: str = "hash") -> None:
    """Vectors in stored (16-bit) precision, one row per key."""
    vectors.select(key, half_precision(F.col("vec")).alias("vec")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Stored vectors; a row of another length fails the job."""
    vectors = spark.read.parquet(path)
    wrong = F.concat(F.lit(f"expected dim {dim}, found "), F.size("vec").cast("string"))
    return vectors.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(wrong)))


BUCKET_BYTES = 128 * 1024 * 1024


def buckets_for(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Number of buckets of a table: none larger than ``BUCKET_BYTES``, and work for every core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows * row_bytes // BUCKET_BYTES))


def _bucketed_name(path: str) -> str:
    return f"chunkweave_{hashlib.md5(path.encode()).hexdigest()}"


def write_by_hash(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """``rows`` as files laid out by hash of ``key`` and sorted by it: joins and groupings on the key read
    them as they lie."""
    dealt = rows.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(_bucketed_name(path))


def read_by_hash(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A table written by ``write_by_hash``, maybe in another session. The files carry their layout in
    their names; the session's catalogue only learns of it here."""
    name = _bucketed_name(path)
    if not spark.catalog.tableExists(name):
        place = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def key_values(lines: DataFrame) -> DataFrame:
    """``(file, line_no, value)`` lines to ``(file, key, value)``; the last line of a key wins.

    Comments, blank lines and lines without a colon are skipped; quotes around values are removed.
    """
    line = strip(F.col("value"))
    parts = F.split(line, ":", 2)
    unquoted = F.trim(F.trim(strip(F.get(parts, F.lit(1))), F.lit('"')), F.lit("'"))
    fields = lines.where(~line.startswith("#") & F.contains(line, F.lit(":"))).select(
        "file", "line_no", strip(F.get(parts, F.lit(0))).alias("key"), unquoted.alias("field")
    )
    return fields.where(F.col("key") != "").groupBy("file", "key").agg(F.max_by("field", "line_no").alias("value"))


def read_key_values(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Key-value text files to ``(file, key, value)``."""
    texts = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(split_lines(F.col("value"))).alias("line_no", "value")
    )
    return key_values(texts)


def key_value_text(fields: Column) -> Column:
    """A string map as the text of a key-value file, keys sorted, values quoted where needed."""

    def line(entry: Column) -> Column:
        value = entry["value"]
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.concat(
            entry["key"], F.lit(": "), F.when(value.rlike(r"[:#\n\r\t]"), quoted).otherwise(value)
        )

    return F.concat(F.array_join(F.transform(F.array_sort(F.map_entries(fields)), line), "\n"), F.lit("\n"))


MANIFEST_SECTIONS = ("similarity", "files", "source", "incremental", "checksums")


def _section(payload: Column, name: str) -> Column:
    fields = F.try_variant_get(payload, f"$.{name}", "map<string,variant>")
    plain = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return F.coalesce(F.transform_values(fields, lambda _, v: plain(v)), F.create_map().cast("map<string,string>"))


def read_manifests(spark: SparkSession, root: str, package_section: str = "package") -> DataFrame:
    """Manifests of all packets below ``root/name/version``; unknown keys are kept in ``extras``.

    Unreadable manifests give a row with null fields, so a catalogue listing shows the packet.
    """
    files = spark.read.text(f"{root.rstrip('/')}/*/*/manifest.json", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    payload = F.col("payload")
    known = ("schema_version", "packet_id", "embedding", "counts", package_section, *MANIFEST_SECTIONS)
    parsed = files.select(
        F.try_element_at(parts, F.lit(-3)).alias("dir_name"),
        F.try_element_at(parts, F.lit(-2)).alias("dir_version"),
        F.regexp_replace("_metadata.file_path", "/manifest\\.json$", "").alias("path"),
        F.try_parse_json("value").alias("payload"),
    )
    text = lambda field: F.try_variant_get(payload, f"$.{field}", "string")
    extras = F.map_filter(
        F.transform_values(F.try_variant_get(payload, "$", "map<string,variant>"), lambda _, v: F.to_json(v)),
        lambda k, _: ~k.isin(*known),
    )
    return parsed.select(
        "dir_name",
        "dir_version",
        "path",
        text("schema_version").alias("schema_version"),
        text("packet_id").alias("packet_id"),
        F.struct(
            text("embedding.provider").alias("provider"),
            text("embedding.model").alias("model"),
            F.try_variant_get(payload, "$.embedding.dim", "int").alias("dim"),
            text("embedding.dtype").alias("dtype"),
            F.try_variant_get(payload, "$.embedding.normalized", "boolean").alias("normalized"),
            F.try_variant_get(payload, "$.embedding.max_seq_length", "int").alias("max_seq_length"),
        ).alias("embedding"),
        F.coalesce(
            F.try_variant_get(payload, "$.counts", "map<string,int>"), F.create_map().cast("map<string,int>")
        ).alias("counts"),
        _section(payload, package_section).alias("package"),
        *[_section(payload, name).alias(name) for name in MANIFEST_SECTIONS],
        F.coalesce(extras, F.create_map().cast("map<string,string>")).alias("extras"),
    )


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Manifest rows into the catalogue, one partition per packet version, others untouched."""
    manifests.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "version").parquet(path)


REGISTRY_TABLES = {
    "packages": "id bigint, name string, created_at timestamp",
    "versions": (
        "id bigint, package_id bigint, version string, sha256 string, size_bytes bigint, object_key string, "
        "checksum string, published_at timestamp, yanked boolean, manifest_json string"
    ),
    "audit_log": "id bigint, ts timestamp, action string, package string, version string, sha256 string, remote string",
}


def read_registry(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(REGISTRY_TABLES[table]).parquet(f"{root}/{table}")


def append_registry(rows: DataFrame, root: str, table: str) -> None:
    schema = REGISTRY_TABLES[table]
    names = [column.split()[0] for column in schema.split(", ")]
    rows.select(*names).write.mode("append").parquet(f"{root}/{table}")
