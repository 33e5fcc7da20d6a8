"""Packets on storage: run folders, and a manifest that names the current one.

``packet/runs/<run>/`` holds the tables of one build. ``packet/manifest.json`` names the tables and is
put in place whole, after everything it names is written. A build that fails leaves the former
manifest and its tables untouched, and a build may read the packet it replaces.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from chunkweave.sources.tables import read_by_hash

MANIFEST = "manifest.json"


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def new_run(packet: str) -> str:
    """Folder of a new build, relative to the packet."""
    return f"runs/{uuid.uuid4().hex}"


def read_manifest(spark: SparkSession, packet: str) -> dict | None:
    """The manifest of the current build, or None where there is none. Other faults are errors."""
    path, store = _hadoop_path(spark, f"{packet}/{MANIFEST}")
    if not store.exists(path):
        return None
    return json.loads(spark.read.text(str(path), wholetext=True).first().value)


def publish_manifest(spark: SparkSession, packet: str, manifest: dict) -> None:
    """Write the manifest beside its place and move it there in one step."""
    target, store = _hadoop_path(spark, f"{packet}/{MANIFEST}")
    draft, _ = _hadoop_path(spark, f"{packet}/_{MANIFEST}-{uuid.uuid4().hex}")
    out = store.create(draft, True)
    try:
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context.rename(store.makeQualified(draft), store.makeQualified(target), options)


def packet_table(spark: SparkSession, packet: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of the packet's current build, by the name the manifest gives it."""
    manifest = read_manifest(spark, packet)
    if manifest is None:
        raise ValueError(f"no packet at {packet}")
    return table_of(spark, packet, manifest, name, schema)


def table_of(spark: SparkSession, packet: str, manifest: dict, name: str, schema: str | None = None) -> DataFrame:
    """As ``packet_table``, of a manifest already read; an empty table for a part it has not, if a schema is given."""
    place = (manifest.get("files") or {}).get(name)
    if place is None and schema is not None:
        return spark.createDataFrame([], schema)
    if place is None:
        raise ValueError(f"the packet at {packet} has no {name}")
    layout = (manifest.get("layout") or {}).get(name)
    if layout is not None and layout["place"] == place:
        return read_by_hash(spark, f"{packet}/{place}", layout["schema"], layout["key"], layout["buckets"])
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{packet}/{place}")


def replace_table(rows: DataFrame, root: str, name: str) -> None:
    """Make ``rows`` the table ``root/name``, in one step when all of it is written; the rows may be
    derived from the table they replace."""
    spark, folder = rows.sparkSession, f"{root}/{name}"
    run = new_run(folder)
    rows.write.parquet(f"{folder}/{run}")
    publish_manifest(spark, folder, {"files": {"table": run}})


def read_table(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """A table written by ``replace_table``; an empty one, of the given schema, before the first."""
    folder = f"{root}/{name}"
    manifest = read_manifest(spark, folder)
    if manifest is None and schema is None:
        raise ValueError(f"no table at {folder}")
    return table_of(spark, folder, manifest or {}, "table", schema)


def drop_former_runs(spark: SparkSession, packet: str) -> int:
    """Delete the run folders that the manifest does not name; how many. Not while others read them."""
    manifest = read_manifest(spark, packet) or {}
    kept = {place.split("/")[1] for place in (manifest.get("files") or {}).values() if place.startswith("runs/")}
    folder, store = _hadoop_path(spark, f"{packet}/runs")
    former = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName() not in kept] if kept and store.exists(folder) else []
    for path in former:
        store.delete(path, True)
    return len(former)
