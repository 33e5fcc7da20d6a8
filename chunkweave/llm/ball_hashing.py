"""Near duplicates by SimHash: links between fingerprints that differ in few bits, by ball hashing.

1. Every text becomes a 64-bit fingerprint of its word shingles. Rows of equal fingerprints are one from
   here on.
2. Meet in the middle: two fingerprints differ in at most ``radius`` bits exactly if some 64-bit number
   lies within half of that from both. So every fingerprint stands for all numbers (variants) in the ball
   of half the radius around it, and fingerprints that share a variant collide.
3. Variants are shuffled on their leading bits. The variants of one fingerprint have few different leading
   parts, so what travels is a fingerprint per leading part (37 at 8 bits, for 2081 variants of radius 4),
   packed per task; the receiving task writes out the variants with that leading part. The number of
   leading bits follows from the number of fingerprints; a leading part with too many variants for one
   task is dealt out again on more bits, as often as needed.
4. A task sorts the variants of a leading part, verifies every collision on the full fingerprints, and
   returns each colliding fingerprint with the least one it is connected with there: rows grow with
   fingerprints, never with pairs. Components of these connections are the result.

No bucket is capped, and no link within the radius can be missed.

Defined results: a null, empty or blank text has no words and fingerprint zero, linked like any other; a
text of fewer words than a shingle has one shingle, of all its words; texts of any length are hashed in
pieces; repeated rows are copies. A row without ``doc_id`` is linked like others but gives no component
its name; a component of such rows only has the null id. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import spread_join, stored
from chunkweave.llm.components import components

NGRAM = 4
RADIUS = 4
SEED = 42
BITS = 64
PIECE = 1 << 20
#: Variants that one task sorts at once: as a rule, and at most.
USUAL_VARIANTS, MOST_VARIANTS = 1 << 19, 1 << 20
MORE_BITS = 8
#: Variants of a task, as a rule, one head after another; and most tasks (beyond, each takes more heads).
TASK_VARIANTS, MOST_TASKS = 1 << 24, 20_000
EMITTED = 1 << 18

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_DEALT = "level int, head long, prints binary, variants long"


def shingle_hashes(text: bytes, ngram: int = NGRAM) -> Iterator[np.ndarray]:
    """Unsigned hashes of all shingles, in order, repeats included. Long texts come in pieces that end
    between words; the last words of a piece are carried into the next one."""
    words: list[bytes] = []
    start, some = 0, False
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        words += text[start:end].lower().split()
        start = end
        if len(words) >= ngram:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[: len(words) - ngram] + 1).tolist()]
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[ngram - 1 :].tolist(), strict=True)], dtype="<u8")
            some, words = True, words[len(words) - ngram + 1 :]
    if words and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")


def fingerprint(text: bytes, ngram: int = NGRAM) -> int:
    """Bit i is set if it is set in more than half of the shingles' hashes."""
    ones, number = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, ngram):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        number += len(hashes)
    return int(np.packbits(2 * ones > number, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``(doc_id, print)`` of all rows; the fingerprint as a signed number."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"", ngram) for t in batch.column(1).cast(pa.large_binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long")


@cache
def ball(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with at most ``radius`` of them set."""
    return np.array([sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)], dtype=np.uint64)


def ball_size(bits: int, radius: int) -> int:
    return sum(comb(bits, r) for r in range(radius + 1)) if radius >= 0 else 0


def leading_bits(number: int, half: int) -> int:
    """So many leading bits that a part holds a usual number of variants."""
    bits = MORE_BITS
    while bits < BITS and number * ball_size(BITS, half) >> bits > USUAL_VARIANTS:
        bits += 1
    return bits


def _spent(level: int, head: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Bits in which the leading parts of the fingerprints differ from a head."""
    return np.bitwise_count(head ^ (prints >> np.uint64(BITS - level)) if level else head)


def deal(level: int, head: np.ndarray, prints: np.ndarray, more: int, half: int) -> Iterator[tuple]:
    """Heads longer by ``more`` bits that variants of the fingerprints have below their present heads:
    ``(level, head, packed fingerprints, number of variants)``, one for each head and step."""
    rest = BITS - level - more
    own = (prints >> np.uint64(rest)) & np.uint64((1 << more) - 1)
    spent = _spent(level, head, prints)
    for used in range(half + 1):
        at = np.flatnonzero(spent == used)
        masks = ball(more, half - used)
        step = max(1, EMITTED // len(masks))
        for first in range(0, len(at), step):
            part = at[first : first + step]
            heads = ((head[part] << np.uint64(more) | own[part])[:, None] ^ masks).ravel()
            order = np.argsort(heads, kind="stable")
            heads, packed = heads[order], np.repeat(prints[part], len(masks))[order]
            left = half - used - np.bitwise_count(masks).astype(np.int64)
            sizes = np.tile(np.array([ball_size(rest, x) for x in left.tolist()], dtype=np.int64), len(part))[order]
            cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
            variants = np.add.reduceat(sizes, cuts)
            for a, b, n in zip(cuts.tolist(), [*cuts[1:].tolist(), len(heads)], variants.tolist(), strict=True):
                yield level + more, int(heads[a].view(np.int64)), packed[a:b].tobytes(), n


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    """Rows one by one: the packed fingerprints of a whole batch are not copied at once."""
    for i in range(batch.num_rows):
        yield [column[i].as_py() for column in batch.columns]


def _dealt_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64())
    columns = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["level", "head", "prints", "variants"])


def _dealt_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size > 1 << 23:
            yield _dealt_batch(held)
            held, size = [], 0
    yield _dealt_batch(held)


def collisions(level: int, head: int, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that share a variant with that head, each with the least one it is connected with."""
    prints = np.unique(prints)
    half, rest = radius // 2, BITS - level
    base = np.uint64(head << rest & ((1 << BITS) - 1))
    low = prints & np.uint64((1 << rest) - 1)
    spent = _spent(level, np.uint64(head & ((1 << level) - 1)), prints)
    owners = [np.flatnonzero(spent == used) for used in range(half + 1)]
    parts = [((low[at] | base)[:, None] ^ ball(rest, half - used)).ravel() for used, at in enumerate(owners)]
    ordered = np.sort(np.concatenate(parts))
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(shared):
        return shared, shared
    mark = np.zeros(1 << 20, dtype=bool)
    spread, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
    mark[(shared * spread) >> shift] = True
    bucket, owner = [], []
    for used, (at, part) in enumerate(zip(owners, parts, strict=True)):
        width = len(ball(rest, half - used))
        for first in range(0, len(part), 1 << 20):
            held = part[first : first + (1 << 20)]
            maybe = np.flatnonzero(mark[(held * spread) >> shift])
            place = np.minimum(np.searchsorted(shared, held[maybe]), len(shared) - 1)
            hit = shared[place] == held[maybe]
            bucket.append(place[hit])
            owner.append(at[(maybe[hit] + first) // width])
    bucket, owner = np.concatenate(bucket), np.concatenate(owner)
    least = np.full(len(shared), len(prints))
    np.minimum.at(least, bucket, owner)
    a, b = owner, least[bucket]
    real = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= radius)
    links = np.unique(a[real] * len(prints) + b[real])
    a, b = links // len(prints), links % len(prints)
    root = np.arange(len(prints))
    while True:
        lower = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, lower)
        np.minimum.at(root, b, lower)
        root = root[root]
        if (root == before).all():
            break
    met = np.flatnonzero(root != np.arange(len(prints)))
    return prints[met], prints[root[met]]


def dealt_variants(prints: DataFrame, number: int, radius: int) -> DataFrame:
    """The packed fingerprints by head, no head with more variants than a task takes."""
    half, bits = radius // 2, leading_bits(number, radius // 2)

    def first(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield from _dealt_batches(deal(0, np.zeros(len(own), dtype=np.uint64), own, bits, half))

    def again(batches):
        for batch in batches:
            for level, head, packed, _ in _rows(batch):
                own = np.frombuffer(packed, dtype=np.uint64)
                heads = np.full(len(own), head, dtype=np.int64).view(np.uint64)
                yield from _dealt_batches(deal(level, heads, own, min(MORE_BITS, BITS - level), half))

    dealt = stored(prints.select("print").mapInArrow(first, _DEALT), "balls-dealt")
    ready = None
    while True:
        sizes = dealt.groupBy("level", "head").agg(F.sum("variants").alias("n"))
        heavy = stored(sizes.filter((F.col("n") > MOST_VARIANTS) & (F.col("level") < BITS)).select("level", "head"), "balls-heavy")
        split = not heavy.isEmpty()
        light = dealt.join(heavy, ["level", "head"], "left_anti") if split else dealt
        ready = light if ready is None else ready.unionByName(light)
        if not split:
            return ready
        dealt = stored(dealt.join(heavy, ["level", "head"], "left_semi").select(*dealt.columns).mapInArrow(again, _DEALT), "balls-dealt")


def connections(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: each fingerprint of ``prints(print)``, all different, with one it is connected with by
    links of at most ``radius`` bits; components of these rows are components of all links."""
    if radius % 2 or not 0 < radius <= 8:
        raise ValueError("the radius must be an even number up to 8")

    def run(batches):
        key, held = None, []

        def flush():
            if held:
                a, b = collisions(*key, np.frombuffer(b"".join(held), dtype=np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for level, head, packed, _ in _rows(batch):
                if (level, head) != key:
                    yield from flush()
                    key, held = (level, head), []
                held.append(packed)
        yield from flush()

    number = prints.count()
    tasks = min(MOST_TASKS, max(1, number * ball_size(BITS, radius // 2) // TASK_VARIANTS))
    return dealt_variants(prints, number, radius).repartition(tasks, "level", "head").sortWithinPartitions("level", "head").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per document: the fingerprint as 16 hexadecimal
    digits, and the least ``doc_id`` that links lead to, its own included."""
    prints = stored(fingerprints(docs, ngram), "balls-prints")
    kinds = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "balls-kinds")
    links = stored(connections(kinds, radius).distinct(), "balls-links")
    roots = components(links).select(F.col("node").alias("print"), "root")
    members = stored(kinds.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "balls-members")
    names = stored(
        members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_prints")), "balls-names"
    )
    named = spread_join(members, names, "root", "n_prints").select("print", "n", "component_id")
    found = spread_join(prints, stored(named, "balls-named"), "print", "n")
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
