"""Importance resampling towards a target distribution: hashed features, Gumbel scores, exact ranks.

1. Word runs of all texts are counted per hash bucket, in the corpus and in the target. The logarithm of
   the ratio, in thousandths, is a bucket's gain: one array of fixed size, sent to the tasks.
2. A document's weight is the sum of the gains of its features, looked up in that array. Its score adds
   Gumbel noise that a hash of its id fixes, so the highest scores are a draw without replacement.
3. The draw is a parallel sort by regular sampling. The scored rows are sorted locally into runs, a stored
   table. Rows at regular distances in all runs give the splitters; each run is cut by them into segments.
   Counts per segment, summed before each, say at which rank a segment begins and which segments can hold
   a drawn row at all. Only those are exchanged, sorted, and numbered from their first rank on.

Segments are bounded: between two samples of a run lie fewer rows than the sampling distance. Rows are
ordered by score, id, features and place in their run, so that no group of equal rows is too hot to cut.
At most ``SAMPLES`` rows and one per run reach the driver.

Defined results: a null text has no features and weight 0; texts of any length are taken in pieces. A row
without ``doc_id`` has no hash, so neither score nor rank, and does not count among the eligible ones, but
its text counts in the corpus. Rows of equal id and score go by their number of features; equal rows share
out their ranks in any order. With an empty target the gains only favour rare features; with an empty
table the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.common import stored

BUCKETS = 10_000
MAX_RUN = 1
SEED = 2024
MIN_WORDS = 20
DRAW_PERCENT = 10
SAMPLES = 1 << 16
SEGMENTS = 1024
PIECE = 1 << 20
CACHED_WORDS, CACHED_LENGTH = 200_000, 32

_SPACE = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of words stay or become lower case, all others separate. Bytes of characters beyond ASCII stay.
_FOLDED = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))

_SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words in order, in lists of bounded size."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[start:end].translate(_FOLDED).split()
        start = end


class Buckets(dict):
    """Bucket of a feature; keeps the short ones it has met, up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(feature) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[feature] = found
        return found

    def of(self, features: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def feature_pieces(text: bytes, max_run: int, known: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """``(number of words, buckets of their features)`` piece by piece; runs over a piece's border are
    found with the words carried over."""
    carried: list[bytes] = []
    for words in word_pieces(text):
        found = [known.of(words)]
        joined = carried + words
        for run in range(2, max_run + 1):
            first = max(0, len(carried) - run + 1)
            runs = [b" ".join(joined[i : i + run]) for i in range(first, len(joined) - run + 1)]
            found.append(known.of(runs))
        carried = joined[max(0, len(joined) - max_run + 1) :] if max_run > 1 else []
        yield len(words), np.concatenate(found)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """Number of features of all rows of ``texts(text)`` in each bucket."""

    def run(batches):
        counts, known = np.zeros(buckets, dtype=np.int64), Buckets(buckets)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for _, found in feature_pieces(text.as_py() or b"", max_run, known):
                    counts += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["bucket", "n"])

    added = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, dtype=np.int64)
    counts[added.column("bucket").to_numpy()] = added.column("n").to_numpy()
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over corpus frequency, each bucket counted once more."""
    buckets = len(corpus)
    corpus_sum, target_sum = float(int(corpus.sum()) + buckets), float(int(target.sum()) + buckets)
    return np.array(
        [math.floor(1000.0 * math.log(float(t + 1) * corpus_sum / (float(s + 1) * target_sum))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)],
        dtype=np.int64,
    )


def noise(doc_id: int, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate that the id fixes."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_features, n_words, weight, score)`` of all rows."""
    state = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        own = state.value
        known = Buckets(len(own))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                n_words = n_features = weight = 0
                for words, found in feature_pieces(text.as_py() or b"", max_run, known):
                    n_words, n_features, weight = n_words + words, n_features + len(found), weight + int(own[found].sum())
                rows.append((doc_id, n_features, n_words, weight, None if doc_id is None else weight + noise(doc_id, seed)))
            names = [part.split()[0] for part in _SCORED.split(", ")]
            columns = zip(*rows, strict=True) if rows else ([],) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _SCORED)


def sorted_runs(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(doc_id, n_features, weight, score)`` as stored runs: locally sorted, with ``place``,
    the run's number in the upper bits and the position in the run in the lower 33."""
    local = rows.sortWithinPartitions(F.desc("score"), "doc_id", "n_features")
    return stored(local.withColumn("place", F.monotonically_increasing_id()), "resampling-runs")


def splitters(runs: DataFrame, number: int, samples: int = SAMPLES, segments: int = SEGMENTS) -> list[tuple]:
    """Keys that cut the order into segments, from rows at regular distances in every run."""
    distance = max(1, number // samples)
    at = F.col("place").bitwiseAND((1 << 33) - 1)
    taken = runs.filter(at % distance == distance - 1).select("score", "doc_id", "n_features", "place")
    keys = sorted((-r.score, r.doc_id, r.n_features, r.place) for r in taken.collect())  # at most SAMPLES rows
    step = max(1, len(keys) // segments)
    return keys[step - 1 :: step]


def with_segment(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``runs`` with the number of the segment that each row falls into."""
    state = runs.sparkSession.sparkContext.broadcast(cuts)

    def cut(batches):
        keys = state.value
        bounds = np.array(keys, dtype=np.int64).reshape(-1, 4)
        for batch in batches:
            score, doc, features, place = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("score", "doc_id", "n_features", "place"))
            first = np.searchsorted(bounds[:, 0], -score, side="left")
            last = np.searchsorted(bounds[:, 0], -score, side="right")
            for i in np.flatnonzero(first < last).tolist():  # rows with the score of a splitter
                first[i] = bisect_left(keys, (int(-score[i]), int(doc[i]), int(features[i]), int(place[i])), int(first[i]), int(last[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32())], names=[*batch.schema.names, "segment"])

    return runs.mapInArrow(cut, "doc_id long, n_features long, weight long, score long, place long, segment int")


def ranked(rows: DataFrame, percent: int = DRAW_PERCENT) -> DataFrame:
    """``rows(doc_id, n_features, weight, score)`` with ``rank``: 1, 2, ... by falling score for so many
    percent of them, null for the others."""
    runs = sorted_runs(rows)
    number = runs.count()
    drawn = percent * number // 100
    cut = stored(with_segment(runs, splitters(runs, number)), "resampling-segments")
    counts = sorted((r["segment"], r["count"]) for r in cut.groupBy("segment").count().collect())  # a row per segment
    before, begins = 0, []
    for segment, n in counts:
        begins.append((segment, before))
        before += n
    wanted = [(s, b) for s, b in begins if b < drawn]
    last = max((s for s, _ in wanted), default=-1)
    spark = rows.sparkSession
    order = Window.partitionBy("segment").orderBy(F.desc("score"), "doc_id", "n_features", "place")
    exchanged = (
        cut.filter(F.col("segment") <= last)
        .withColumn("within", F.row_number().over(order))
        .join(F.broadcast(spark.createDataFrame(wanted, "segment int, before long")), "segment")  # a row per segment
        .withColumn("rank", F.col("before") + F.col("within"))
    )
    names = ("doc_id", "n_features", "weight", "score")
    front = exchanged.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return front.unionByName(cut.filter(F.col("segment") > last).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = DRAW_PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    max_run: int = MAX_RUN,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs(doc_id, text)``; the rows with a
    rank are the draw. ``target(text)`` shows the distribution that the draw should resemble."""
    gain = gains(bucket_counts(docs, buckets, max_run), bucket_counts(target, buckets, max_run))
    rows = stored(scored(docs, gain, max_run, seed), "resampling-scored")
    eligible = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    names = ("doc_id", "n_features", "weight", "score")
    others = rows.filter(~eligible).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked(rows.filter(eligible).select(*names), percent).unionByName(others)
