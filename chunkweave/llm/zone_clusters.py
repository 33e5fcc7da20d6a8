"""Exact centroid clustering over blocks of vectors in the order of a space-filling curve.

1. Vectors become integers and get the Hilbert index of their quantised components as key. They are sorted
   by it over the cluster and cut into blocks, each with the least and greatest value of every component:
   a zone map. Blocks are a table in the shared folder, one row each.
2. In every round a task bounds the distance of a block's box to each centroid. Centroids whose least
   distance to the box is above the least of all greatest distances can be nearest to no vector of the
   block; the others are its candidates.
3. All vectors of the block are compared with the candidates exactly, as one matrix product.
4. A task returns sums and counts per cluster; Spark adds them up. Only clusters x components numbers
   reach the driver, and only the centroids go back.

Arithmetic is exact at any size: in doubles while results stay below 2^52, in 64-bit integers below
2^62, in unbounded integers beyond.

Defined results: rows take part whose vector has the asked number of components, none null or not
finite; integers beyond 64 bits take the nearest 64-bit value; distances and their sums saturate at 64
bits. Rows without an id are assigned but never start a centroid. Repeated rows are vectors like others;
of rows of equal id the smaller vector starts a centroid first. With fewer such rows than clusters there
are as many clusters as rows; without any the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import stored
from chunkweave.llm.exact_topk import usable

DIMS = 64
SCALE = 256.0
CLUSTERS = 40
ROUNDS = 5
SEED = 2
BLOCK_ROWS = 128
CURVE_BITS = 4
LARGEST = (1 << 63) - 1

_BLOCK = "size int, ids array<long>, components array<long>, low array<long>, high array<long>"


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part."""
    kept = vectors.filter(usable(F.col("embedding")) & (F.size("embedding") == dims))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``points`` (components below ``2**bits``) as bytes, most significant first.

    The axes are first turned into the frame of each finer cube, from coarse to fine, then Gray-coded.
    """
    n, dims = points.shape
    x = np.ascontiguousarray(points.T.astype(np.uint32))
    for level in range(bits - 1, 0, -1):
        side = np.uint32(1 << level)
        below = side - np.uint32(1)
        for d in range(dims):
            inverted = (x[d] & side) != 0
            swapped = np.where(inverted, np.uint32(0), (x[0] ^ x[d]) & below)
            x[0] ^= np.where(inverted, below, swapped)
            if d:
                x[d] ^= swapped
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(n, dtype=np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint32(1 << level)) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    digits = (x.T[:, None, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(digits.reshape(n, bits * dims).astype(np.uint8), axis=1)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def curve_ordered(integers: DataFrame, dims: int) -> DataFrame:
    """``(key, vec_id, v)`` sorted along the curve. The box of the curve leaves out the outermost hundredth
    at both ends; values beyond take its border."""
    bounds = integers.agg(
        F.percentile_approx(F.array_min("v"), 0.01).alias("low"), F.percentile_approx(F.array_max("v"), 0.99).alias("high")
    ).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    cells = 1 << CURVE_BITS
    width = max(high - low, 0) // cells + 1

    def key(batches):
        for batch in batches:
            inside = np.clip(_matrix(batch.column(1), dims), low, max(low, high))
            keys = hilbert_keys((inside.astype(np.uint64) - np.uint64(low & ((1 << 64) - 1))) // np.uint64(width), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), *batch.columns], names=["key", "vec_id", "v"])

    keyed = integers.mapInArrow(key, "key binary, vec_id long, v array<long>")
    return keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")


def build_blocks(integers: DataFrame, dims: int = DIMS) -> DataFrame:
    """The stored blocks of ``integers(vec_id, v)``."""

    def pack(batches):
        def block(ids: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
            def one(values: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))

            held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(ids)], pa.int32()), held, one(matrix.ravel()), one(matrix.min(axis=0)), one(matrix.max(axis=0))],
                names=["size", "ids", "components", "low", "high"],
            )

        ids, matrix = pa.array([], pa.int64()), np.zeros((0, dims), dtype=np.int64)
        for batch in batches:
            ids, matrix = pa.concat_arrays([ids, batch.column(0)]), np.concatenate([matrix, _matrix(batch.column(1), dims)])
            whole = len(ids) // BLOCK_ROWS * BLOCK_ROWS
            for at in range(0, whole, BLOCK_ROWS):
                yield block(ids[at : at + BLOCK_ROWS], matrix[at : at + BLOCK_ROWS])
            ids, matrix = ids[whole:], matrix[whole:]
        if len(ids):
            yield block(ids, matrix)

    return stored(curve_ordered(integers, dims).select("vec_id", "v").mapInArrow(pack, _BLOCK), "zone-blocks")


def exact_kind(dims: int, *values: np.ndarray):
    """A number type in which squared distances between the values are exact."""
    most = 2 * max((max(abs(int(v.min())), abs(int(v.max()))) for v in values if v.size), default=0) + 2
    size = dims * most * most
    return np.float64 if size < 1 << 52 else np.int64 if size < 1 << 62 else object


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, kind) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a point of the box, ascending."""
    below, above = low.astype(kind) - centroids.astype(kind), centroids.astype(kind) - high.astype(kind)
    gap = np.maximum(np.maximum(below, above), 0)
    reach = np.maximum(np.abs(below), np.abs(above))
    return np.flatnonzero((gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min())


def nearest(matrix: np.ndarray, centroids: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of every row, the first of equals, and the squared distance."""
    points, centres = matrix.astype(kind), centroids.astype(kind)
    distance = (points * points).sum(axis=1)[:, None] - 2 * (points @ centres.T) + (centres * centres).sum(axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(matrix)), best]


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    """``(ids, matrix, low, high)`` of each block."""
    named = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        flat = {name: named[name][i].values.to_numpy(zero_copy_only=False) for name in ("components", "low", "high")}
        yield named["ids"][i].values, flat["components"].reshape(-1, dims), flat["low"], flat["high"]


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple]:
    """``(ids, matrix, cluster, distance)`` of each block."""
    for ids, matrix, low, high in _blocks(batch, centroids.shape[1]):
        kind = exact_kind(centroids.shape[1], low, high, centroids)
        possible = candidates(low, high, centroids, kind)
        best, distance = nearest(matrix, centroids[possible], kind)
        yield ids, matrix, possible[best], distance


def zone_map(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(size, candidates)`` of each block: how many vectors, and how many centroids they are compared with."""

    def run(batches):
        for batch in batches:
            found = [
                len(candidates(low, high, centroids, exact_kind(centroids.shape[1], low, high, centroids)))
                for _, _, low, high in _blocks(batch, centroids.shape[1])
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["size", "candidates"])

    return blocks.mapInArrow(run, "size int, candidates int")


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    state = blocks.sparkSession.sparkContext.broadcast(centroids)
    clusters, dims = centroids.shape

    def run(batches):
        own = state.value
        counts, totals = np.zeros(clusters, dtype=np.int64), np.zeros((clusters, dims), dtype=object)
        held, size = np.zeros((clusters, dims), dtype=np.int64), 0
        for batch in batches:
            for _, matrix, cluster, _ in _assigned(batch, own):
                most = (max(abs(int(matrix.min())), abs(int(matrix.max()))) + 1) * len(matrix)
                if size + most >= 1 << 62:
                    totals, held, size = totals + held, np.zeros_like(held), 0
                wide = most >= 1 << 62
                for number in np.unique(cluster):
                    rows = matrix[cluster == number]
                    counts[number] += len(rows)
                    if wide:
                        totals[number] += rows.astype(object).sum(axis=0)
                    else:
                        held[number] += rows.sum(axis=0)
                size += 0 if wide else most
        totals = totals + held
        met = np.flatnonzero(counts)
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(met, pa.int32()),
                pa.array(counts[met], pa.int64()),
                pa.array([[Decimal(int(x)) for x in totals[number]] for number in met], pa.list_(kind)),
            ],
            names=["cluster", "n", "sums"],
        )

    parts = blocks.mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    found = centroids.copy()
    for row in added.collect():  # clusters x components rows
        found[row["cluster"], row["d"]] = int(row["x"]) // row["n"]
    return found


def starting_centroids(integers: DataFrame, clusters: int, seed: int) -> np.ndarray:
    hashed = integers.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    rows = hashed.orderBy("h", "v").limit(clusters).collect()  # as many rows as clusters
    return np.array([r["v"] for r in rows], dtype=np.int64)


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""
    state = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            for ids, _, cluster, distance in _assigned(batch, state.value):
                bounded = [min(int(x), LARGEST) for x in distance] if distance.dtype == object else distance.astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(bounded, pa.int64())], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def _saturated(total):
    return F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: float = SCALE
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per vector."""
    spark = vectors.sparkSession
    integers = stored(integer_vectors(vectors, dims, scale), "zone-vectors")
    blocks = build_blocks(integers, dims)
    centroids = starting_centroids(integers, clusters, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    found = stored(assigned(blocks, centroids), "zone-assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = sums.agg(F.sum("own").alias("all"))
    named = (
        sums.crossJoin(F.broadcast(whole))  # one row
        .join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
        .select("cluster", _saturated(F.col("own")).alias("cluster_inertia"), _saturated(F.col("all")).alias("inertia"), "centroid_sha256")
    )
    return found.join(F.broadcast(named), "cluster").select(*[part.split()[0] for part in schema.split(", ")])  # a row per cluster
