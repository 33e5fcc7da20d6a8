"""Packing and splitting of documents that do not fit a row: one row per line, dealt over tasks.

The folds of ``packing`` and ``constraints`` walk a document inside its row. Here a document is
``lines(doc, position, text)`` and no task ever holds more than a block of it:

1. Lines get their number within the document from running counts of the sorted runs.
2. Blocks of lines, with a margin of neighbours as wide as a part can be, find for every line where
   the part that starts there ends: prefix sums and binary search, all lines at once.
3. Following these ends from one line to the next is a chain. Inside a block pointer doubling gives,
   for each line at which the chain may enter, where it leaves and how many parts it has made. These
   tables are composed over groups of blocks, and groups of groups, until one is left; on the way back
   every block learns where the chain really enters it and the number of its first part.
4. Blocks write the parts that start in them.

A document of one block needs none of this: such documents are dealt out whole, sorted, and each task writes
their parts as it reads them, one after the other.

Parts are those of the fold, whatever the size of blocks. A line without document or position belongs
to no document. Of lines at equal positions the order is by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.functions.text import ANY_SPACE, SPACE_CHARS, rstrip, word_count
from chunkweave.operators.constraints import MAX_CHUNK_TOKENS
from chunkweave.operators.packing import _budget
from chunkweave.sources.tables import stored

BLOCK_LINES = 1 << 16
BLOCK_CHARS = 1 << 23
FAN = 256
#: Where the chain enters or leaves a block if it waits for the next line with text.
WAITING = -1


@dataclass(frozen=True)
class Rule:
    """How parts begin and end.

    ``ends(sizes, here, whole)`` gets the numbers of all lines at hand (one column each), the places
    of the lines a part may start at, and whether the first line of the document is the first one at
    hand; it gives the place where each part's text begins, and the place of the line that starts the
    next part, ``len`` for the end of what is at hand, or ``WAITING``.
    """

    sizes: dict[str, Column]
    before: int  # lines that a part may repeat
    after: int  # lines that a part may have
    ends: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]
    starts: Callable[[dict[str, np.ndarray]], np.ndarray]  # lines that a waiting chain may enter at
    first: int = 0  # how the chain enters a document


def _numbered(lines: DataFrame, sizes: list[str]) -> DataFrame:
    """``(doc, at, text, sizes...)`` with the number of each line in its document."""
    runs = stored(
        lines.repartitionByRange("doc", "position", "text").sortWithinPartitions("doc", "position", "text")
        .select("doc", "text", *sizes)
        .withColumn("place", F.monotonically_increasing_id()),
        "long-lines",
    )
    run = F.shiftright("place", 33).alias("run")
    earlier = Window.partitionBy("doc").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # A row per run and document in it.
    counted = runs.groupBy("doc", run).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    begins = counted.select("doc", "run", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"))
    numbered = runs.withColumn("run", run).join(begins, ["doc", "run"])
    return numbered.select("doc", (F.col("place") - F.col("first") + F.col("lines_before")).alias("at"), "text", *sizes)


def _blocks(numbered: DataFrame, rule: Rule, size: int, columns: list[str]) -> DataFrame:
    """Every line in its block, and in the neighbours' margins: ``(doc, block, at, columns...)``."""
    own, inside = F.floor(F.col("at") / size), F.pmod("at", F.lit(size))
    places = F.array(
        own,
        F.when((inside < rule.after) & (own > 0), own - 1),
        F.when(inside >= size - rule.before, own + 1),
    )
    return numbered.select("doc", F.explode(F.array_compact(places)).alias("block"), "at", *columns)


def _arrays(table: pa.Table, names) -> dict[str, np.ndarray]:
    return {name: table.column(name).to_numpy() for name in names}


def _own(at: np.ndarray, block: int, size: int) -> np.ndarray:
    """Places of the block's own lines among those at hand."""
    return np.flatnonzero((at >= block * size) & (at < (block + 1) * size))


def _leaving(nxt: np.ndarray, starts: np.ndarray, doors: int) -> tuple[np.ndarray, np.ndarray]:
    """For each way in (the first ``doors`` lines, then waiting): how the chain leaves the block, and
    the number of parts that begin on the way."""
    n = len(nxt)
    waiting = n + doors  # beyond every place in reach
    to = np.r_[np.where(nxt == WAITING, waiting, nxt), np.arange(n, n + doors + 1)]
    parts = np.r_[np.ones(n, dtype=np.int64), np.zeros(doors + 1, dtype=np.int64)]
    while True:
        further = to[to]
        if (further == to).all():
            break
        parts, to = parts + np.where(to < n, parts[to], 0), further
    entry = int(np.flatnonzero(starts)[0]) if starts.any() else waiting
    ways = np.r_[np.arange(doors), entry]
    leaves = to[ways] - n
    return np.where(leaves >= doors, WAITING, leaves), parts[ways]


_MAP = "doc string, block long, leaves array<int>, parts array<long>"


def _map_row(doc: str, block: int, leaves: np.ndarray, parts: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "doc": pa.array([doc], pa.string()),
            "block": pa.array([block], pa.int64()),
            "leaves": pa.array([leaves.astype(np.int32)], pa.list_(pa.int32())),
            "parts": pa.array([parts], pa.list_(pa.int64())),
        }
    )


_NO_MAP = pa.table({"doc": pa.array([], pa.string()), "block": pa.array([], pa.int64()), "leaves": pa.array([], pa.list_(pa.int32())), "parts": pa.array([], pa.list_(pa.int64()))})
_ENTRY = "doc string, block long, enters int, number long"


def _tables(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(block, leaves, parts)`` in order of the blocks."""
    rows = zip(table.column("block").to_pylist(), table.column("leaves"), table.column("parts"), strict=True)
    return sorted(((b, to.values.to_numpy(), n.values.to_numpy()) for b, to, n in rows), key=lambda r: r[0])


def _composed(key, table):
    """One table for a group of blocks. ``WAITING`` is the last way in, so -1 finds it as an index."""
    to = parts = None
    for _, leaves, made in _tables(table):
        if to is None:
            to, parts = leaves.astype(np.int64), made
        else:
            to, parts = leaves[to].astype(np.int64), parts + made[to]
    return _map_row(key[0].as_py(), key[1].as_py(), to, parts)


def _entered(key, tables, ways):
    """Where the chain enters each block of a group that it enters as ``ways`` says."""
    enters, number, rows = ways.column("enters")[0].as_py(), ways.column("number")[0].as_py(), []
    for block, leaves, made in _tables(tables):
        rows.append((block, enters, number))
        enters, number = int(leaves[enters]), number + int(made[enters])
    columns = list(zip(*rows, strict=True))
    kinds = {"block": pa.int64(), "enters": pa.int32(), "number": pa.int64()}
    return pa.table({"doc": pa.array([key[0].as_py()] * len(rows), pa.string()), **{n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}})


def _entries(maps: DataFrame, first: int, fan: int) -> DataFrame:
    """``(doc, block, enters, number)``: where the chain enters each block, and its first part there."""
    last = maps.agg(F.max("block")).first()[0] or 0
    group = F.floor(F.col("block") / fan)
    if last < fan:
        above = maps.select("doc", F.lit(0).cast("long").alias("block"), F.lit(first).alias("enters"), F.lit(0).cast("long").alias("number")).distinct()
    else:
        upper = maps.groupBy("doc", group.alias("group")).applyInArrow(_composed, _MAP)
        above = _entries(stored(upper, "long-maps"), first, fan)
    grouped = maps.withColumn("group", group).groupBy("doc", "group")
    return grouped.cogroup(above.withColumnRenamed("block", "group").groupBy("doc", "group")).applyInArrow(_entered, _ENTRY)


_PARTS = "doc string, ord long, text string"


def _part_rows(docs: list[str], numbers: list[int], texts: list[str]) -> pa.Table:
    return pa.table({"doc": pa.array(docs, pa.string()), "ord": pa.array(numbers, pa.int64()), "text": pa.array(texts, pa.string())})


def _chain(lines, begin, nxt, here: int, n_own: int, n_before: int) -> Iterator[str]:
    """The parts that start from ``here`` on among a block's own lines, ``n_before`` lines at hand before them."""
    while here < n_own:
        end = len(lines) if nxt[here] == WAITING else int(nxt[here])
        yield "\n".join(lines[int(begin[here]) : end]).strip(SPACE_CHARS)
        here = n_own if nxt[here] == WAITING else end - n_before


def _entry(rule_starts, sizes: dict[str, np.ndarray], own: np.ndarray, enters: int) -> int:
    """The place among the own lines at which the chain enters."""
    if enters != WAITING:
        return enters
    open_lines = np.flatnonzero(rule_starts(sizes)[own])
    return int(open_lines[0]) if len(open_lines) else len(own)


def _whole_parts(lines: DataFrame, rule: Rule) -> DataFrame:
    """The parts of documents of at most one block. A task holds a batch of lines and the one document that
    the batch leaves open."""
    names, ends, starts, first = list(rule.sizes), rule.ends, rule.starts, rule.first

    def written(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in chain(tables, [None]):
            rows = left if batch is None else pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            rows = rows.combine_chunks()
            of = rows.column("doc").to_pylist()
            edges = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
            if batch is not None:  # the last document may go on
                left = rows.slice(edges[-2])
                edges.pop()
            texts, sizes = rows.column("text").slice(0, edges[-1]).to_pylist(), _arrays(rows, names)
            docs, numbers, parts = [], [], []
            for a, b in zip(edges, edges[1:], strict=False):
                mine, own = {name: values[a:b] for name, values in sizes.items()}, np.arange(b - a)
                begin, nxt = ends(mine, own)
                made = list(_chain(texts[a:b], begin, nxt, _entry(starts, mine, own, first), b - a, 0))
                docs += [of[a]] * len(made)
                numbers += range(len(made))
                parts += made
            yield from _part_rows(docs, numbers, parts).to_batches()

    dealt = lines.repartition("doc").sortWithinPartitions("doc", "position", "text")
    return dealt.select("doc", "text", *names).mapInArrow(written, _PARTS)


def _parts(lines: DataFrame, rule: Rule, block_lines: int, fan: int) -> DataFrame:
    size = max(block_lines, rule.before, rule.after)
    kept = lines.where(F.col("doc").isNotNull() & F.col("position").isNotNull())
    sized = stored(kept.select("doc", "position", "text", *[value.alias(name) for name, value in rule.sizes.items()]), "long-sized")
    large = stored(
        sized.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
        .where((F.col("n") > size) | (F.col("chars") > BLOCK_CHARS)).select("doc"),
        "long-documents",
    )
    if large.isEmpty():
        return _whole_parts(sized, rule)
    whole = _whole_parts(sized.join(large, "doc", "left_anti"), rule)
    return whole.unionByName(_block_parts(sized.join(large, "doc", "left_semi"), rule, size, fan))


def _block_parts(lines: DataFrame, rule: Rule, size: int, fan: int) -> DataFrame:
    doors = rule.after + 1
    numbered = stored(_numbered(lines, list(rule.sizes)), "long-numbered")
    names, ends, starts = list(rule.sizes), rule.ends, rule.starts  # the rule itself holds columns

    def linked(table: pa.Table, block: int):
        table = table.sort_by("at")
        sizes, at = _arrays(table, names), table.column("at").to_numpy()
        own = _own(at, block, size)
        begin, nxt = ends(sizes, own) if len(own) else (own, own)
        return table, sizes, own, begin, nxt

    def mapped(key, table):
        _, sizes, own, _, nxt = linked(table, key[1].as_py())
        if not len(own):  # a margin behind the last line
            return _NO_MAP
        inside = np.where(nxt == WAITING, WAITING, nxt - own[0])
        return _map_row(key[0].as_py(), key[1].as_py(), *_leaving(inside, starts(sizes)[own], doors))

    def written(key, table, ways):
        numbers, texts = [], []
        if table.num_rows and ways.num_rows:
            table, sizes, own, begin, nxt = linked(table, key[1].as_py())
            here = _entry(starts, sizes, own, ways.column("enters")[0].as_py())
            texts = list(_chain(table.column("text").to_pylist(), begin, nxt, here, len(own), int(own[0]) if len(own) else 0))
            numbers = [ways.column("number")[0].as_py() + i for i in range(len(texts))]
        return _part_rows([key[0].as_py()] * len(numbers), numbers, texts)

    maps = stored(_blocks(numbered, rule, size, names).groupBy("doc", "block").applyInArrow(mapped, _MAP), "long-maps")
    entries = stored(_entries(maps, rule.first, fan), "long-entries")
    blocks = _blocks(numbered, rule, size, ["text", *names]).groupBy("doc", "block")
    return blocks.cogroup(entries.groupBy("doc", "block")).applyInArrow(written, _PARTS)


def pack_long_lines(
    lines: DataFrame,
    *,
    target_tokens: int = 220,
    overlap_tokens: int = 40,
    count: Callable[[Column], Column] = word_count,
    block_lines: int = BLOCK_LINES,
    fan: int = FAN,
) -> DataFrame:
    """``lines(doc string, position, text)`` to ``(doc, ord, text)``: the parts that ``micro_split``
    makes of the joined lines, in order. ``count`` gives at least one for a line that is not blank."""
    target, overlap = _budget(target_tokens, overlap_tokens, None)

    def ends(sizes, here):
        n = sizes["tokens"]
        if n.min() < 1:
            raise ValueError("a line with text counts as less than one token")
        before = np.r_[0, np.cumsum(n)]
        begin = here
        if overlap:
            begin = np.searchsorted(before, before[here] - overlap, side="left")
            begin = np.maximum(np.minimum(begin, here - 1), 0)
        over = np.searchsorted(before, before[begin] + target, side="right")
        return begin, np.maximum(over - 1, here + 1)

    kept = lines.withColumn("text", rstrip(F.col("text"))).where("text <> ''")
    rule = Rule({"tokens": count(F.col("text")).cast("long")}, overlap, target + 1, ends, lambda sizes: np.ones(len(sizes["tokens"]), dtype=bool))
    return _parts(kept, rule, block_lines, fan)


def split_long_lines(
    lines: DataFrame, max_tokens: int = MAX_CHUNK_TOKENS, *, block_lines: int = BLOCK_LINES, fan: int = FAN
) -> DataFrame:
    """``lines(doc string, position, text)`` to ``(doc, ord, text)``: the parts that ``oversize_parts``
    makes of the joined lines, in order. Parts start at lines with text; those in between that are
    blank stay inside."""
    limit = 4 * (max_tokens + 1)  # the first trimmed length that is too long

    def ends(sizes, here):
        line_at = np.r_[0, np.cumsum(sizes["length"] + 1)][:-1]
        filled = np.flatnonzero(sizes["last"] > 0)
        start, stop = line_at + sizes["lead"], (line_at + sizes["last"])[filled]
        over = np.searchsorted(stop, start[here] + limit, side="left")
        over = np.maximum(over, np.searchsorted(filled, here, side="right"))
        return here, np.where(over < len(filled), filled[np.minimum(over, len(filled) - 1)], WAITING) if len(filled) else np.full(len(here), WAITING)

    text = F.col("text")
    last = F.length(rstrip(text))
    sizes = {
        "length": F.length(text).cast("long"),
        "last": last.cast("long"),
        "lead": F.length(F.regexp_extract(text, f"^{ANY_SPACE}*", 0)).cast("long"),
    }
    rule = Rule(sizes, 0, limit + 1, ends, lambda sizes: sizes["last"] > 0, first=WAITING)
    return _parts(lines.where(text.isNotNull()), rule, block_lines, fan)


def read_long_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text files of any size to ``lines(doc, position, text)``: a file is split over tasks, and lines
    are ordered by the split they are in, then as read."""
    rows = spark.read.text(paths)
    return rows.select(
        F.col("_metadata.file_path").alias("doc"),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("position"),
        F.col("value").alias("text"),
    )
