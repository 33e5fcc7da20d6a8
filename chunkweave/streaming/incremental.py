"""Incremental builds as a stream of arriving documents.

State is keyed. A path's state is its generation and the digest of what it held: a document that comes
again unchanged goes no further, a changed one is the next generation and names the one it replaces. Paths
share ``BUCKETS`` keys, and each is looked up in the map of its key: one call of Python serves many paths. A
hash's state is that it was seen: only the first text of a hash is ever embedded. So no batch reads what
is stored, however much that is. Each batch writes folders of its own, and a replayed batch, which finds
the state of the batch before, writes the same rows there again. ``compact`` removes former generations.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from chunkweave.functions.vectors import half_precision
from chunkweave.functions.wordbag import Embedder
from chunkweave.operators import embedding as E
from chunkweave.plans.build import PacketSpec, line_window_chunks

ARRIVED = "path string, ext string, content string"
CHANGED = f"{ARRIVED}, generation bigint, previous bigint"
CHUNKS = (
    "chunk_id string, path string, ord int, text string, hash string, metadata map<string,string>, "
    "generation bigint, batch_id bigint"
)
PATHS = "path string, generation bigint, previous bigint, batch_id bigint"
SHAPE = "dim int, batch_id bigint"
BUCKETS = 8192  # keys of the paths' state; a stream that has begun cannot change it
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch stores what it changed, not the files of the whole store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _place(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    store, hadoop = _place(spark, path)
    return store.exists(hadoop)


def _remove(spark: SparkSession, path: str) -> None:
    store, hadoop = _place(spark, path)
    store.delete(hadoop, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of folders called ``name=number``."""
    store, hadoop = _place(spark, path)
    found = store.listStatus(hadoop) if store.exists(hadoop) else []
    names = [status.getPath().getName() for status in found]
    return [int(name.split("=")[1]) for name in names if "=" in name]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches stored so far; an empty table before the first one."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _start(spark: SparkSession, rows: DataFrame, batch, checkpoint: str, trigger: dict) -> StreamingQuery:
    """The query with its state in RocksDB. A query keeps the settings it was started with."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _greatest(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per path: of the greatest content, then extension; null is least."""
    order = rows.sort_values(["path", "content", "ext"], na_position="first", kind="stable")
    return order.drop_duplicates("path", keep="last")


class Generations(StatefulProcessor):
    """The next generation of each path whose content or extension differs from the last one's. A key is a
    bucket of paths: rows of one batch in one bucket are handled together, and only their paths are looked up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "path string", "generation bigint, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            best = _greatest(frame if best is None else pd.concat([best, frame]))
        changed, begun = [], self.last.exists()  # asked once: nothing is looked up in a bucket without paths
        for found in best[["path", "ext", "content"]].itertuples(index=False):
            path, ext, content = (None if pd.isna(value) else value for value in found)
            digest = hashlib.sha256(json.dumps([ext, content]).encode()).hexdigest()
            previous, known = (begun and self.last.getValue((path,))) or (None, None)
            if digest != known:
                generation = (previous or 0) + 1
                self.last.updateValue((path,), (generation, digest))
                changed.append((path, ext, content, generation, previous))
        if changed:
            out = pd.DataFrame(changed, columns=["path", "ext", "content", "generation", "previous"])
            yield out.astype({"previous": "Int64"})

    def close(self) -> None:
        pass


def changed_documents(documents: DataFrame) -> DataFrame:
    """``documents(path, ext, content)`` as a stream to those that are new or changed, with their
    generation and the one they replace. Tasks keep one row per path of an Arrow batch before the
    shuffle, so a path that arrives again and again does not send all its rows to one task."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pc.count_distinct(batch.column(0), mode="all").as_py() < batch.num_rows:
                batch = pa.RecordBatch.from_pandas(_greatest(batch.to_pandas()), schema=batch.schema, preserve_index=False)
            yield batch

    arrived = documents.select(*(F.col(name).cast("string").alias(name) for name in ("path", "ext", "content")))
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")
    keyed = arrived.mapInArrow(combine, ARRIVED).withColumn("bucket", bucket).groupBy("bucket")
    return keyed.transformWithStateInPandas(Generations(), CHANGED, "Append", "None")


def embed_new_texts(spark: SparkSession, out: str, spec: PacketSpec, embedder: Embedder, checkpoint: str) -> None:
    """Whatever lies in ``out/texts`` now, hashes seen before left out, to ``out/vectors``.

    The first batch with vectors fixes their dimension. Vectors must be finite, and are normalised unless
    the server does it: a batch cannot see the whole table, so ``auto`` normalises every vector, which
    leaves unit vectors as they are. A replay writes its texts again; ``ignoreMissingFiles`` lets go of the files they replace.
    """
    mode = "client" if spec.normalization == "auto" else spec.normalization

    def embed(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        E.embed_texts(batch, embedder).write.mode("overwrite").parquet(f"{out}/fresh")
        fresh = session.read.parquet(f"{out}/fresh")
        # A replay must not hold on to what this very batch stored before it failed.
        fixed = _stored(session, f"{out}/shape", SHAPE).where(F.col("batch_id") != batch_id).first()
        dim = fixed.dim if fixed else E.vector_shape(fresh).first().max_dim
        if dim is None:
            return
        vectors = E.normalize_table(E.checked_vectors(fresh, dim), mode).withColumn("vec", half_precision(F.col("vec")))
        vectors.write.mode("overwrite").parquet(f"{out}/vectors/batch_id={batch_id}")
        if not fixed:
            session.createDataFrame([(dim, batch_id)], SHAPE).write.mode("overwrite").parquet(f"{out}/shape")

    texts = spark.readStream.schema("hash string, text string").option("ignoreMissingFiles", "true").parquet(f"{out}/texts/*")
    query = _start(spark, texts.dropDuplicates(["hash"]), embed, checkpoint, {"availableNow": True})
    query.awaitTermination()


def ingest_stream(
    documents: DataFrame, out: str, spec: PacketSpec, embedder: Embedder, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """``documents(path, ext, content)`` as a stream into ``out/paths``, ``out/chunks`` and ``out/vectors``.

    Of several rows for one path in a batch the one with the greatest content counts. Every batch has its
    new texts embedded before its paths are written, so a path is current only when its chunks and
    vectors are there.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived, texts, own = f"{out}/arrived", f"{out}/texts/{batch_id}", f"batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(arrived)  # read more than once below; the state is asked once
        changed = spark.read.schema(CHANGED).parquet(arrived)
        line_window_chunks(changed, spec, keep=("generation",)).write.mode("overwrite").parquet(f"{out}/chunks/{own}")
        E.distinct_texts(spark.read.parquet(f"{out}/chunks/{own}")).write.mode("overwrite").parquet(texts)
        embed_new_texts(spark, out, spec, embedder, f"{checkpoint}/texts")
        # Last: a path is current only when its chunks and vectors are there.
        changed.select("path", "generation", "previous").write.mode("overwrite").parquet(f"{out}/paths/{own}")
        _remove(spark, texts)
        _remove(spark, arrived)

    session = documents.sparkSession
    return _start(session, changed_documents(documents), ingest, checkpoint, trigger or {"availableNow": True})


def _compacted(spark: SparkSession, out: str) -> int:
    """The last batch that ``compact`` has taken in; -1 before the first time."""
    return _stored(spark, f"{out}/compacted", "upto bigint").agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("upto")).first().upto


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each path's last generation; a path that is blank now has none. Batches that are not
    finished do not show. Only generations replaced since ``compact`` are looked up, not all paths."""
    upto = _compacted(spark, out)
    paths = _stored(spark, f"{out}/paths", PATHS).where(F.col("batch_id") > upto)
    finished = paths.agg(F.coalesce(F.max("batch_id"), F.lit(upto)).alias("last")).first().last
    chunks = _stored(spark, f"{out}/chunks", CHUNKS).where(F.col("batch_id").between(upto + 1, finished))
    if upto >= 0:
        chunks = chunks.unionByName(spark.read.schema(CHUNKS).parquet(f"{out}/base/upto={upto}"))
    gone = paths.where("previous IS NOT NULL").select(F.col("path").alias("gone"), F.col("previous").alias("gone_generation"))
    replaced = F.col("path").eqNullSafe(F.col("gone")) & (F.col("generation") == F.col("gone_generation"))
    return chunks.join(gone, replaced, "left_anti")


def compact(spark: SparkSession, out: str) -> int | None:
    """Removes replaced generations: what is current of the finished batches becomes one table, and their
    own folders go. Gives the last batch taken in, None if there was nothing new.

    The new table counts once its number is written down, so a failure before that changes nothing, and a
    batch replayed later writes folders that nobody reads. Readers that began earlier lose their files.
    Vectors stay: a hash that was seen is not embedded again when its text comes back.
    """
    upto = _compacted(spark, out)
    paths = _stored(spark, f"{out}/paths", PATHS).where(F.col("batch_id") > upto)
    last = paths.agg(F.max("batch_id").alias("last")).first().last
    if last is None:
        return None
    current_chunks(spark, out).where(F.col("batch_id") <= last).write.mode("overwrite").parquet(f"{out}/base/upto={last}")
    spark.createDataFrame([(last,)], "upto bigint").write.mode("append").parquet(f"{out}/compacted")
    for table, name, keep in (("chunks", "batch_id", None), ("paths", "batch_id", None), ("base", "upto", last)):
        for number in _numbers(spark, f"{out}/{table}"):
            if number <= last and number != keep:
                _remove(spark, f"{out}/{table}/{name}={number}")
    return last
