"""Token counts per document of flat token files, which hold ids and end-of-document ids and no index.

Files are listed with their lengths only; each becomes rows of (file, first block, blocks), which are dealt
over the tasks. A task reads the ranges of its own rows and searches them in blocks, all ids of a block at
once, for the end-of-document id. A block alone knows the lengths of the documents inside it, but not of
the one it begins with: it may have begun any number of blocks before. What each block leaves open is a
row; a prefix scan over these rows (running sums, and a running maximum that finds the last block with an
end) gives every block the length it inherits and the number of documents before it.

``write_token_files`` makes such files of a table of texts with Spark's text writer: a row is a text's
ids as raw bytes, the separator of the rows is the end-of-document id. Files
can have any size; the writer makes one per input split.

Ranges are read by pyarrow's file systems (local, HDFS, S3 and those it knows). In a store that only Spark
reads, a file is one value of its binary source, which fails beyond 2 GB.

Defined results: empty documents (two ends in a row) count 0 tokens; ids after the last end of a file are
one more document, marked as not ended; an empty file has none; null texts are empty documents. A file
whose size is no multiple of the id width fails the job: it is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.llm.bpe import LEXICON_WORDS, encode_packed
from chunkweave.llm.common import new_folder, stored
from chunkweave.sources.hidden import SAME_STORE

END_ID = 50256
BLOCK_TOKENS = 1 << 20
#: Neighbouring blocks of a row, and the least bytes or rows that make more tasks than there are cores.
RANGE_BLOCKS = 16
TASK_BYTES = 128 << 20
TASK_RANGES = 1000


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, lexicon_words: int = LEXICON_WORDS) -> str:
    """Writes the texts as flat files of 16-bit ids and returns the folder."""
    folder = new_folder(docs.sparkSession, "token-files")
    packed = encode_packed(docs, tokenizer, lexicon_words).select(F.col("packed").cast("string"))
    separator = int(end_id).to_bytes(2, "little").decode("latin-1")
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(folder)
    return folder


def block_summary(block: np.ndarray, end_id: int) -> tuple[int, int, int, np.ndarray]:
    """Ends, ids before the first and after the last end, lengths of the documents between them."""
    ends = np.flatnonzero(block == end_id)
    if not len(ends):
        return 0, len(block), len(block), np.zeros(0, dtype=np.int64)
    return len(ends), int(ends[0]), len(block) - int(ends[-1]) - 1, np.diff(ends) - 1


def _opened(path: str):
    """``(pyarrow file system, path in it)`` of a path as Spark names it."""
    from pyarrow import fs

    scheme, mark, rest = path.partition(":")
    if not mark or scheme == "file":
        # Spark writes file:/a, file:///a or /a, and gives the characters of a name as they are.
        return fs.LocalFileSystem(), "/" + (rest if mark else path).lstrip("/")
    return fs.FileSystem.from_uri(f"{SAME_STORE.get(scheme, scheme)}:{rest}")


def _readable(path: str) -> bool:
    """Whether pyarrow reaches the path's store."""
    try:
        store, place = _opened(path)
        return store.get_file_info(place).is_file
    except (ValueError, OSError, NotImplementedError):
        return False


def _summaries(path: str, first: int, ids: Iterator[np.ndarray], end_id: int) -> Iterator[pa.RecordBatch]:
    for number, block in enumerate(ids, first):
        ends, head, tail, inner = block_summary(block, end_id)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([path], pa.string()),
                pa.array([number], pa.int64()),
                pa.array([ends], pa.int64()),
                pa.array([head], pa.int64()),
                pa.array([tail], pa.int64()),
                pa.array([inner], pa.list_(pa.int64())),
            ],
            names=["file", "block", "ends", "head", "tail", "inner"],
        )


def scan_blocks(spark: SparkSession, folder: str, end_id: int, dtype: str, block_tokens: int, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """``(file, block, ends, head, tail, inner)``, one row per block of each file.

    A task takes ``range_blocks`` neighbouring blocks at a time and holds one of them."""
    width = np.dtype(dtype).itemsize
    schema = "file string, block long, ends long, head long, tail long, inner array<long>"
    files = spark.read.format("binaryFile").load(folder)

    def run_whole(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                if data.size % width:
                    raise ValueError(f"{path} ends inside an id")
                ids = np.frombuffer(data, dtype=dtype)
                yield from _summaries(path, 0, (ids[at : at + block_tokens] for at in range(0, len(ids), block_tokens)), end_id)

    def run(batches):
        for batch in batches:
            for path, length, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{path} ends inside an id")
                store, place = _opened(path)
                start, stop = (min(length, n * block_tokens * width) for n in (first, first + range_blocks))
                with store.open_input_file(place) as file:

                    def blocks(file=file, path=path, start=start, stop=stop):
                        for at in range(start, stop, block_tokens * width):
                            wanted = min(stop - at, block_tokens * width)
                            data = file.read_at(wanted, at)
                            if len(data) != wanted:
                                raise ValueError(f"{path} is shorter than it was when listed")
                            yield np.frombuffer(data, dtype=dtype)

                    yield from _summaries(path, first, blocks(), end_id)

    first = files.select("path").first()
    if first is not None and not _readable(first.path):
        return files.select("path", "content").mapInArrow(run_whole, schema)
    size = range_blocks * block_tokens * width
    firsts = F.expr(f"transform(sequence(0L, (length - 1) div {size}L), i -> i * {range_blocks}L)")
    ranges = files.filter("length > 0").select("path", "length", F.explode(firsts).alias("first"))
    total = ranges.agg(F.count("*").alias("n"), F.sum(F.least(F.lit(size), F.col("length") - F.col("first") * block_tokens * width)).alias("bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, (total.bytes or 0) // TASK_BYTES, total.n // TASK_RANGES)
    return ranges.repartition(tasks).mapInArrow(run, schema)


def stitched(blocks: DataFrame) -> DataFrame:
    """``(file, doc_no, n_tokens, ended)`` of block rows, by prefix scans along each file."""
    order = Window.partitionBy("file").orderBy("block")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    # Every block passes on what follows its last end; S is the running sum of that. What a block inherits
    # is S before it less S before the last block with an end, and S never falls, so that is a maximum.
    summed = blocks.withColumn("s", F.sum("tail").over(upto)).withColumn("s_before", F.col("s") - F.col("tail"))
    scanned = summed.withColumns(
        {
            "carry": F.col("s_before") - F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("s_before"))).over(before), F.lit(0)),
            "docs_before": F.coalesce(F.sum("ends").over(before), F.lit(0)),
            "last": F.lead("block").over(order).isNull(),
        }
    )
    whole = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    found = scanned.select("file", "docs_before", F.posexplode(whole).alias("i", "n_tokens"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    open_end = scanned.filter("last").select("file", (F.col("docs_before") + F.col("ends")).alias("doc_no"), left.alias("n_tokens")).filter("n_tokens > 0")
    return found.select("file", (F.col("docs_before") + F.col("i")).alias("doc_no"), "n_tokens", F.lit(True).alias("ended")).unionByName(
        open_end.withColumn("ended", F.lit(False))
    )


def count_tokens(spark: SparkSession, folder: str, end_id: int = END_ID, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token count of every document in the files of a folder, numbered along each file."""
    return stitched(stored(scan_blocks(spark, folder, end_id, dtype, block_tokens), "token-blocks"))


def table_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, n_tokens)`` of a stored table: its texts go to flat files, the scan counts them, and
    the n-th document of a file is the n-th row of the input split that wrote it."""
    spark = docs.sparkSession
    folder = write_token_files(docs, tokenizer)
    counted = count_tokens(spark, folder).withColumn("split", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
    rows = docs.select(
        "doc_id", F.spark_partition_id().alias("of_split"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("of_no")
    )
    named = stored(rows, "token-rows").join(counted, (F.col("of_split") == F.col("split")) & (F.col("of_no") == F.col("doc_no")), "left")
    return named.select("doc_id", F.coalesce("n_tokens", F.raise_error(F.lit("a document is missing from the token files"))).alias("n_tokens"))
