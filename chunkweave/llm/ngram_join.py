"""N-gram Jaccard join by MinHash banding, and the near-duplicate classes it gives.

1. Every text becomes the set of its word five-grams (hashed to 64 bits), a digest of the set and one
   hash per band of its MinHash signature. Texts with equal sets form one copy class from here on.
2. Classes that share a band hash are candidates. Each band bucket becomes a star of edges, never
   pairs; components of these edges are the candidate groups.
3. The full sets of a group's members meet in cells of bounded size (a large group is cut into blocks,
   every two blocks meet in one cell). A task counts common n-grams of the members by matrix products,
   keeps exact links, and returns per member the number of linked documents and the least member it is
   connected with: rows grow with members, not with pairs.
4. Components of the verified connections are the classes.

The number of rows per band is the largest for which a pair at the threshold is found with the target
recall within the hash budget. No bucket, partner list or candidate list is capped. Counting the links
of m different near copies takes about m*m/2 set comparisons, in cells spread over the cluster.

Defined results: null and empty texts have no n-grams, so no links, and are classes of their own; a
text of one to four words has one n-gram; repeated rows are copies; a row without ``doc_id`` belongs to
its copy class, but a class of only such rows has no links. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.common import stored
from chunkweave.llm.components import components
from chunkweave.llm.wordhash import mix, ngram_set, set_digest

NGRAM = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999
MAX_HASHES = 128
SMALL_BLOCK, LARGE_BLOCK, USUAL_BLOCKS = 64, 1024, 24


def bands_and_rows(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Most rows per band (fewest false candidates) that reach the recall at the threshold."""
    for rows in range(32, 0, -1):
        p = float(threshold) ** rows
        bands = 1 if p >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("the hash budget is too small for this recall")


def band_hashes(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    random = np.random.default_rng(7)
    factor = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(items), 4096):
        least = np.minimum(least, (items[start : start + 4096, None] * factor + shift).min(axis=0))
    place = random.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mix((mix(least).reshape(bands, rows) * place).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def fingerprints(docs: DataFrame, ngram: int = NGRAM, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``(doc_id, digest, bands)``; digest and bands are null for texts without n-grams."""
    bands, rows = bands_and_rows(threshold)

    def run(batches):
        for batch in batches:
            digests, hashes = [], []
            for text in _texts(batch.column(1)):
                items = ngram_set(text or b"", ngram)
                digests.append(set_digest(items) if len(items) else None)
                hashes.append(band_hashes(items, bands, rows).view(np.int64) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """``(node, root)``: classes that share a band with another one, by candidate group."""
    rows = classes.filter("rep IS NOT NULL").select(F.col("digest").alias("node"), F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    edges = rows.join(heads.select(F.col("band").alias("of_band"), "head"), F.col("band") == F.col("of_band"))
    return components(edges.select(F.col("node").alias("a"), F.col("head").alias("b")))


def _cells(groups: DataFrame) -> DataFrame:
    """``(node, root, left, right, block)``: each member once per cell of its group that it takes part in."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n")).withColumnRenamed("root", "of_root")
    size = F.least(F.greatest(F.lit(SMALL_BLOCK), F.ceil(F.col("n") / USUAL_BLOCKS)), F.lit(LARGE_BLOCK))
    dealt = (
        groups.join(sizes, F.col("root") == F.col("of_root"))
        .withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    return dealt.select("node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "node", "root", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    )


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections, by products of 0/1 slabs over the shared items."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.r_[True, values[1:] != values[:-1]]
    number = np.cumsum(first) - 1
    often = np.bincount(number) > 1
    keep = often[number]
    number, owner = (np.cumsum(often) - 1)[number[keep]], owner[keep]
    common = np.zeros((n, n), dtype=np.int64)
    shared = int(number[-1]) + 1 if len(number) else 0
    height = max(1, min(shared, (1 << 22) // n))
    cuts = np.searchsorted(number, np.arange(0, shared + height, height))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        slab = np.zeros((height, n), dtype=np.float32)
        slab[number[a:b] - i * height, owner[a:b]] = 1
        common += np.rint(slab.T @ slab).astype(np.int64)
    return common


def linked_members(members: list[tuple], threshold: Fraction) -> np.ndarray:
    """Boolean matrix of the exact links of one cell's members ``(node, block, rep, copies, set)``."""
    sizes = np.array([len(m[4]) for m in members], dtype=np.int64)
    common = common_counts([m[4] for m in members])
    p, q = threshold.numerator, threshold.denominator
    links = common * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(links, False)
    return links


def _cell_members(batches, threshold: Fraction, emit):
    """Calls ``emit(members, links)`` for each cell of the sorted input, across batch boundaries."""
    key, members, seen = None, [], set()

    def flush():
        if len(members) > 1:
            links = linked_members(members, threshold)
            blocks = np.array([m[1] for m in members])
            if key[1] != key[2]:  # pairs inside a block belong to the block's own cell
                links &= blocks[:, None] != blocks[None, :]
            if links.any():
                yield emit(members, links)

    for batch in batches:
        columns = [batch.column(i) for i in range(7)]
        flat, offsets = columns[6].values.to_numpy(zero_copy_only=False).view(np.uint64), columns[6].offsets.to_numpy()
        plain = [c.to_pylist() for c in columns[:6]]
        for i, (root, left, right, block, node, copies) in enumerate(zip(*plain, strict=True)):
            if (root, left, right) != key:
                yield from flush()
                key, members, seen = (root, left, right), [], set()
            if node not in seen:
                seen.add(node)
                members.append((node, block, None, copies, flat[offsets[i] : offsets[i + 1]].copy()))
    yield from flush()


def _heads(links: np.ndarray) -> np.ndarray:
    """Number of the first member that each member is connected with."""
    head = np.full(len(links), -1)
    for start in range(len(links)):
        if head[start] < 0:
            frontier = np.zeros(len(links), dtype=bool)
            frontier[start] = True
            reached = frontier
            while frontier.any():
                frontier = links[frontier].any(axis=0) & ~reached
                reached = reached | frontier
            head[reached] = start
    return head


def _with_sets(docs: DataFrame, classes: DataFrame, groups: DataFrame, ngram: int) -> DataFrame:
    """Sorted cell rows ``(root, left, right, block, node, copies, items)``."""
    wanted = stored(
        groups.join(classes.select("digest", "rep", "copies"), F.col("node") == F.col("digest")).select("rep", "node", "root", "copies"),
        "join-members",
    )

    def sets(batches):
        for batch in batches:
            kept, items = [], []
            for i, (node, text) in enumerate(zip(batch.column(0).to_pylist(), _texts(batch.column(3)), strict=True)):
                found = ngram_set(text or b"", ngram)
                if len(found) and set_digest(found) == node:  # not another text under the same doc_id
                    kept.append(i)
                    items.append(found.view(np.int64))
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), pa.array(items, pa.list_(pa.int64()))],
                names=["node", "root", "copies", "items"],
            )

    texts = docs.select(F.col("doc_id").alias("own_id"), "text")
    fetched = (
        texts.join(wanted.hint("merge"), F.col("own_id") == F.col("rep"))  # members grow with the corpus: never broadcast
        .select("node", "root", "copies", "text")
        .mapInArrow(sets, "node binary, root binary, copies long, items array<long>")
    )
    cells = _cells(groups).withColumnRenamed("node", "of_node").drop("root")
    return (
        fetched.join(cells, F.col("node") == F.col("of_node"))
        .select("root", "left", "right", "block", "node", "copies", "items")
        .repartition("root", "left", "right")
        .sortWithinPartitions("root", "left", "right")
    )


def _prepared(docs: DataFrame, ngram: int, threshold: Fraction):
    prints = stored(fingerprints(docs, ngram, threshold), "join-fingerprints")
    classes = stored(
        prints.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")),
        "join-classes",
    )
    groups = stored(candidate_groups(classes), "join-groups")
    return prints, classes, groups


def similar_pairs(docs: DataFrame, ngram: int = NGRAM, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The join itself: ``(doc_a, doc_b)`` of the representatives (least ``doc_id``) of linked copy classes."""
    _, classes, groups = _prepared(docs, ngram, threshold)

    def emit(members, links):
        a, b = np.nonzero(links)
        smaller = [members[i][0] < members[j][0] for i, j in zip(a, b, strict=True)]
        pairs = [(members[i][0], members[j][0]) for i, j, s in zip(a, b, smaller, strict=True) if s]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"]
        )

    def run(batches):
        yield from _cell_members(batches, threshold, emit)

    pairs = _with_sets(docs, classes, groups, ngram).mapInArrow(run, "a binary, b binary")
    names = classes.select("digest", "rep")
    one = names.select(F.col("digest").alias("da"), F.col("rep").alias("ra"))
    two = names.select(F.col("digest").alias("db"), F.col("rep").alias("rb"))
    return (
        pairs.join(one, F.col("a") == F.col("da"))
        .join(two, F.col("b") == F.col("db"))
        .select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"))
    )


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``(doc_id, class_id, copy_id, n_links)``, one row per document.

    ``class_id``: least ``doc_id`` of the documents it is connected with by links; ``copy_id``: least
    ``doc_id`` with the same n-gram set; ``n_links``: number of other documents that are similar enough.
    """
    prints, classes, groups = _prepared(docs, ngram, threshold)

    def emit(members, links):
        copies = np.array([m[3] for m in members], dtype=np.int64)
        head = _heads(links)
        kept = np.flatnonzero(links.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([members[i][0] for i in kept], pa.binary()),
                pa.array([members[head[i]][0] for i in kept], pa.binary()),
                pa.array((links @ copies)[kept], pa.int64()),
            ],
            names=["node", "head", "links"],
        )

    def run(batches):
        yield from _cell_members(batches, threshold, emit)

    verified = stored(
        _with_sets(docs, classes, groups, ngram).mapInArrow(run, "node binary, head binary, links long"), "join-links"
    )
    roots = components(verified.select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("node", "root_of")
    links = verified.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "links_of")
    rated = stored(
        classes.select("digest", "rep", "copies")
        .join(roots, F.col("digest") == F.col("root_of"), "left")
        .join(links, F.col("digest") == F.col("links_of"), "left")
        .select(
            "digest",
            "rep",
            F.coalesce("root", "digest").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "join-rated",
    )
    least = rated.groupBy("root").agg(F.min("rep").alias("class_id")).withColumnRenamed("root", "of_root")
    named = rated.join(least, F.col("root") == F.col("of_root")).select(
        F.col("digest").alias("of_digest"), F.col("rep").alias("copy_id"), "class_id", "n_links"
    )
    found = prints.filter("digest IS NOT NULL").join(named, F.col("digest") == F.col("of_digest"))
    alone = prints.filter("digest IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links")
    )
    return found.select("doc_id", "class_id", "copy_id", "n_links").unionByName(alone)


def deduplicated(docs: DataFrame, ngram: int = NGRAM, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the least ``doc_id``; all columns stay as they are.

    Rows without ``doc_id`` cannot be told apart and stay; rows equal in ``doc_id`` and text are one.
    """
    classes = near_duplicates(docs, ngram, threshold)
    kept = stored(classes.filter("doc_id = class_id").select("class_id").distinct(), "join-kept").hint("merge")
    stays = docs.join(kept, docs["doc_id"] == kept["class_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return stays.unionByName(docs.filter(docs["doc_id"].isNull()))
