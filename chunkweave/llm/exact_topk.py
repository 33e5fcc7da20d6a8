"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Integer vectors are dealt into shards of bounded size. In a shard every dimension is a posting list, cut
into segments of equal quantised value. For a query, a segment's impact is the largest part of the score
that a vector in it can gain there; segments of all dimensions are processed by descending impact. After
each round a vector's score lies between what it has gained and that plus what the dimensions it has not
been met in can still give. A round ends the search only on proof: all vectors whose upper bound is below
the k-th lower bound are out, and few enough are left. The possible members are scored exactly.

The index is a table in the shared folder with one row per shard. Queries come in blocks of bounded size,
each sent to all tasks; a task keeps k rows per query over all its shards, so what is shuffled is
queries x tasks x k. Vectors stay where they are.

Defined results: rows with a null id, and vectors that are null or hold a null or non-finite component,
take no part; several vectors of one id are candidates each, and as queries share one list of hits; no
vector of the query's own id is a hit; shorter vectors count as filled up with zeros; equal scores go to the smaller id; scores beyond 64 bits saturate. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.common import new_folder, stored

SCALE = 1024.0
SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
LEVELS = 128
ROUNDS = 12
SAFE = 1 << 52

_SHARD = "shard int, dims int, ids array<long>, components array<long>, postings array<int>, starts array<int>, lows array<long>, highs array<long>, of_dim array<int>"


def scaled(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~bad


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part."""
    valid = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return valid.select("vec_id", scaled(F.col("embedding")).alias("v"))


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    found = np.zeros((len(rows), max((len(r) for r in rows), default=0)), dtype=np.int64)
    for i, row in enumerate(rows):
        found[i, : len(row)] = row
    return found


def index_shard(shard: int, ids: np.ndarray, matrix: np.ndarray) -> dict:
    """Posting segments of one shard: places sorted by dimension and quantised value."""
    n, dims = matrix.shape
    postings, starts, lows, highs, of_dim = [], [], [], [], []
    for d in range(dims):
        values = matrix[:, d]
        low, high = int(values.min()), int(values.max())
        width = max(1, -(-(high - low + 1) // LEVELS))
        level = np.array([(int(x) - low) // width for x in values]) if high - low >= 1 << 62 else (values - low) // width
        order = np.argsort(level, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(level[order]) != 0])
        postings.append(order)
        for cut, end in zip(cuts, [*cuts[1:], n], strict=True):
            held = values[order[cut:end]]
            starts.append(d * n + cut)
            lows.append(int(held.min()))
            highs.append(int(held.max()))
            of_dim.append(d)
    return {
        "shard": shard,
        "dims": dims,
        "ids": ids,
        "components": matrix.ravel(),
        "postings": np.concatenate(postings).astype(np.int32) if postings else np.zeros(0, np.int32),
        "starts": starts,
        "lows": lows,
        "highs": highs,
        "of_dim": of_dim,
    }


def build_index(vectors: DataFrame) -> DataFrame:
    """The stored index of ``vectors(vec_id, v)``, a stored table, one row per shard."""
    shards = max(1, -(-vectors.count() // SHARD_ROWS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([index_shard(int(group["shard"].iloc[0]), group["vec_id"].to_numpy(), _matrix(list(group["v"])))])

    # By the place of a stored row, so that many rows of one id or one vector are dealt out as well.
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(build, _SHARD), "topk-index")


class Shard:
    def __init__(self, row: dict):
        self.ids = np.asarray(row["ids"], dtype=np.int64)
        self.n, self.dims = len(self.ids), row["dims"]
        self.matrix = np.asarray(row["components"], dtype=np.int64).reshape(self.n, self.dims)
        self.postings = np.asarray(row["postings"], dtype=np.int64)
        self.starts = np.asarray(row["starts"], dtype=np.int64)
        self.sizes = np.diff(np.r_[self.starts, len(self.postings)])
        self.lows, self.highs = np.asarray(row["lows"], dtype=np.int64), np.asarray(row["highs"], dtype=np.int64)
        self.of_dim = np.asarray(row["of_dim"], dtype=np.int64)
        self.largest = max((abs(int(x)) for x in (*self.lows, *self.highs)), default=0)

    def possible(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Places of all vectors that can be among the k best."""
        everyone = np.flatnonzero(self.ids != own)
        safe = max((abs(int(x)) for x in query), default=0) * self.largest * max(1, self.dims) < SAFE
        if len(everyone) <= k or self.dims == 0 or not safe:
            return everyone
        weight = query[self.of_dim].astype(np.float64)
        one, two = weight * self.lows, weight * self.highs
        least, most = np.minimum(one, two), np.maximum(one, two)
        floor = np.full(self.dims, np.inf)
        np.minimum.at(floor, self.of_dim, least)
        gain, impact = least - floor[self.of_dim], most - floor[self.of_dim]
        slack = np.zeros(self.dims)
        np.maximum.at(slack, self.of_dim, most - least)
        order = np.argsort(-impact, kind="stable")
        sizes = self.sizes[order]
        done = np.cumsum(sizes)
        low, met = np.zeros(self.n), np.zeros(self.n)
        slack_sum, few = slack.sum(), max(8 * k, self.n // 64)
        for i in range(ROUNDS):
            a, b = (int(np.searchsorted(done, done[-1] * step / ROUNDS, side="left" if step < ROUNDS else "right")) for step in (i, i + 1))
            at = order[a:b]
            if len(at):
                own_sizes = sizes[a:b]
                inside = np.arange(own_sizes.sum()) - np.repeat(np.cumsum(own_sizes) - own_sizes, own_sizes)
                places = self.postings[np.repeat(self.starts[at], own_sizes) + inside]
                low += np.bincount(places, np.repeat(gain[at], own_sizes), self.n)
                met += np.bincount(places, minlength=self.n)
            ahead = impact[order[b]] if b < len(order) else 0.0
            bar = np.partition(low[everyone], len(everyone) - k)[len(everyone) - k]
            left = everyone[low[everyone] + slack_sum + ahead * (self.dims - met[everyone]) >= bar]
            if len(left) <= few:
                break
        return left

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best of this shard."""
        width = min(len(query), self.dims)
        padded = np.zeros(self.dims, dtype=np.int64)
        padded[:width] = query[:width]
        places = self.possible(padded, own, k)
        if max((abs(int(x)) for x in padded), default=0) * self.largest * max(1, self.dims) < 1 << 62:
            scores = self.matrix[places] @ padded
        else:
            exact = self.matrix[places].astype(object) @ padded.astype(object)
            scores = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in exact], dtype=np.int64)
        return top(self.ids[places], scores, k)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    chosen = np.lexsort((ids, ~scores))[:k]  # ~ turns the order without overflow
    return ids[chosen], scores[chosen]


def _search_block(index: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    state = index.sparkSession.sparkContext.broadcast([(i, np.array(v, dtype=np.int64)) for i, v in queries])

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)})
                for query_id, query in state.value:
                    ids, scores = shard.best(query, query_id, k)
                    if query_id in best:
                        ids, scores = np.r_[best[query_id][0], ids], np.r_[best[query_id][1], scores]
                    best[query_id] = top(ids, scores, k)
        if best:
            sizes = [len(ids) for ids, _ in best.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(list(best), sizes), pa.int64()),
                    pa.array(np.concatenate([ids for ids, _ in best.values()]), pa.int64()),
                    pa.array(np.concatenate([scores for _, scores in best.values()]), pa.int64()),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other vectors of every vector that is a query."""
    spark = vectors.sparkSession
    integers = stored(integer_vectors(vectors), "topk-vectors")
    index = build_index(integers)
    queries = integers.filter(is_query)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    dealt = stored(queries.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "topk-queries")
    folder = new_folder(spark, "topk-hits")
    for block in range(blocks):
        own = [(r.vec_id, r.v) for r in dealt.filter(F.col("block") == block).select("vec_id", "v").collect()]
        _search_block(index, own, k).write.mode("append").parquet(folder)
    hits = spark.read.schema("query_id long, vec_id long, score long").parquet(folder)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
