"""Fixed line windows and build-wide chunk numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.functions.arrays import span
from chunkweave.functions.text import join_lines, let, path_parts, split_lines

LINES_PER_CHUNK = 80
OVERLAP_LINES = 10
FILES_PER_RANGE = 250_000
MAX_RANGES = 1_000


def line_windows(
    text: Column, lines_per_chunk: int = LINES_PER_CHUNK, overlap_lines: int = OVERLAP_LINES
) -> Column:
    """Windows of lines, each sharing ``overlap_lines`` with the one before, as an array of texts.

    The number of windows has a closed form, so nothing loops: the last window is the first one to
    reach the end of the file. Blank windows are dropped.
    """

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        width = F.lit(lines_per_chunk) if lines_per_chunk > 0 else F.greatest(n, F.lit(1))
        overlap = F.greatest(F.least(F.lit(overlap_lines), width - 1), F.lit(0))
        step = F.greatest(width - overlap, F.lit(1))
        count = F.when(n == 0, F.lit(0)).otherwise(
            (F.ceil(F.greatest(n - width, F.lit(0)) / step) + 1).cast("int")
        )
        return F.transform(span(count), lambda i: join_lines(F.slice(lines, i * step + 1, width)))

    return F.filter(let(split_lines(text), cut), lambda window: window != "")


def line_chunks(
    sources: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK, overlap_lines: int = OVERLAP_LINES
) -> DataFrame:
    """``sources(path, ..., content)`` to ``chunks(path, ..., ord, text)``; no shuffle."""
    return sources.select(
        *[c for c in sources.columns if c != "content"],
        F.posexplode(line_windows(F.col("content"), lines_per_chunk, overlap_lines)).alias("ord", "text"),
    )


def _range_bounds(files: DataFrame, ranges: int, rows: int) -> list[list[str]]:
    """Split points from a sample; any split points give right results, these balance the work."""
    wanted = ranges * 40
    fraction = min(1.0, wanted / max(rows, 1))
    sample = sorted(r[0] for r in files.sample(fraction, seed=7).select(path_parts(F.col("path"))).collect())
    if not sample:
        return []
    step = max(1, len(sample) // ranges)
    return sample[step::step][: ranges - 1]


def first_numbers(files: DataFrame, ranges: int | None = None, n_files: int | None = None) -> DataFrame:
    """``files(path, n_chunks)`` to ``(path, first_number)``, counting up in path order.

    One build-wide counter needs a running sum over all files. Paths are cut into ranges, each range
    sums on its own, and only one total per range (at most ``MAX_RANGES`` rows) meets in one task.
    """
    if n_files is None:
        n_files = files.count()
    if ranges is None:
        ranges = min(MAX_RANGES, n_files // FILES_PER_RANGE + 1)
    bounds = _range_bounds(files, ranges, n_files) if ranges > 1 else []
    literal = F.array(*[F.array(*[F.lit(part) for part in bound]) for bound in bounds]) if bounds else None
    parts = path_parts(F.col("path"))
    bucket = F.size(F.filter(literal, lambda b: b <= parts)) if bounds else F.lit(0)
    placed = files.withColumn("range_no", bucket)

    inside = Window.partitionBy("range_no").orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range_no").agg(F.sum("n_chunks").alias("range_total"))
    offsets = totals.select(
        "range_no", F.coalesce(F.sum("range_total").over(across), F.lit(0)).alias("range_offset")
    )
    return (
        placed.withColumn("inside", F.coalesce(F.sum("n_chunks").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "range_no")
        .select("path", (F.col("range_offset") + F.col("inside")).alias("first_number"))
    )


def number_chunks(chunks: DataFrame, ranges: int | None = None, n_files: int | None = None) -> DataFrame:
    """Adds ``id = path:number`` with one number sequence over the whole build.

    The rows are joined by path, so pass key columns rather than texts where texts are large. An
    upper bound of the number of files may be given to save a pass over the chunks.
    """
    per_file = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"))
    return (
        chunks.join(first_numbers(per_file, ranges, n_files), "path")
        .withColumn("number", F.col("first_number") + F.col("ord"))
        .withColumn("id", F.concat_ws(":", "path", "number"))
        .drop("first_number")
    )


def local_ids(chunks: DataFrame) -> DataFrame:
    """Adds ``id = path:ord``, which stays the same when other files come or go."""
    return chunks.withColumn("id", F.concat_ws(":", "path", "ord"))
