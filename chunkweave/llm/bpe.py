"""Byte-pair encoding and decoding with a lexicon of frequent words.

Spark counts the words of the whole corpus; the ids of the most frequent ones are found once and
compiled into a minimal acyclic transducer, a file that Spark ships to the executors and that tasks map
into memory. A task looks its distinct words up there, all at once, and merges only the others, exactly.
The lexicon changes the speed, never a result.

The tokenizer file (byte-level pairs) is read on the driver only. Texts give the ids that the
``tokenizers`` library gives for that file without added special tokens; strings of special tokens in a
text become those tokens.

Defined results: a null text counts as empty; an empty text has no ids; very long texts are taken in
slices that end between words; very long words merge with a heap in near-linear time. Decoding skips
nothing; bytes that are no UTF-8 become replacement characters; null ids decode to an empty text.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.automaton import Transducer, build
from chunkweave.llm.common import stored

LEXICON_WORDS = 100_000
LEXICON_CHARS = 12
SLICE = 1 << 20
BATCH_CHARS = 1 << 20
CACHED_WORDS = 200_000
CHECKED_CACHE = 50_000  # where decoding shares the worker
DECODE_IDS = 1 << 17
SHORT = 48
#: Words for counting, close to the exact pattern; a difference only moves the choice of the lexicon.
COUNT_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"

_CUT = regex.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """What tasks need of a tokenizer file: ids of bytes, ranked merges, bytes of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level pair encoding without normaliser")
        to_byte = {c: b for b, c in self._byte_characters().items()}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, number in ids.items():
            self.tokens[number] = bytes(to_byte[c] for c in token)
        for token, number in self.special.items():
            self.tokens[number] = token.encode()
        self.of_byte = [ids[c] for _, c in sorted(self._byte_characters().items())]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.pattern, self.newer = self._patterns(path)

    @staticmethod
    def _byte_characters() -> dict[int, str]:
        """The printable stand-ins of the 256 bytes: printable Latin-1 stays, the rest moves to U+0100 on."""
        stays = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
        moved = [b for b in range(256) if b not in set(stays)]
        return {b: chr(b) for b in stays} | {b: chr(256 + i) for i, b in enumerate(moved)}

    @staticmethod
    def _patterns(path: str) -> tuple[str, str]:
        """The word pattern, and the characters that only ``regex``, of a later Unicode version than the
        tokenizers library, knows as letters or numbers."""
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path).pre_tokenizer
        unassigned = (chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
        recent = regex.findall(r"[\p{L}\p{N}]", "".join(unassigned))
        newer = "".join(c for c in recent if len(words.pre_tokenize_str("a" + c)) > 1 and len(words.pre_tokenize_str("1" + c)) > 1)
        return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", newer


def _ranges(characters: str) -> str:
    codes, found = sorted(map(ord, characters)), []
    for code in codes:
        if found and code == found[-1][1] + 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def _narrow_pattern(pattern: str) -> re.Pattern:
    """The word pattern for texts of characters below U+0100, with classes that ``re`` looks up in a bitmap."""
    below = "".join(map(chr, range(256)))
    letter, number, space = (_ranges("".join(regex.findall(kind, below))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\S", f"[^{space}]")
    return re.compile(spelt.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{space}]"))


def _is_narrow(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Merger:
    """Exact merging of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.of_byte, self.merges = vocabulary.of_byte, vocabulary.merges

    def ids(self, word: bytes) -> list[int]:
        parts = [self.of_byte[b] for b in word]
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        """The best pair again and again; the ranks of pairs that stay are kept."""
        get = self.merges.get
        pairs = [get(pair) for pair in zip(parts, parts[1:])]  # noqa: B905
        while True:
            best = None
            for i, found in enumerate(pairs):
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                return parts
            parts[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get((parts[at - 1], parts[at]))
            if at < len(pairs):
                pairs[at] = get((parts[at], parts[at + 1]))

    def _long(self, parts: list[int]) -> list[int]:
        """The same order of merges with a heap over a linked list."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        alive, heap = [True] * len(parts), []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (found := self.merges.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (found[0], i, parts[i], parts[j], found[1]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i] if alive[i] else len(parts)
            if j >= len(parts) or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = merged, False, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for start in (before[i], i):
                if start >= 0:
                    offer(start)
        return [part for part, kept in zip(parts, alive, strict=True) if kept]


class Encoder:
    """Encodes texts in a task; keeps the ids of words it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: str | None, with_special: bool = True, cached_words: int = CACHED_WORDS):
        self.cached_words = cached_words
        self.merger, self.special = Merger(vocabulary), vocabulary.special if with_special else {}
        self.lexicon = Transducer(lexicon) if lexicon else None
        self.plain = regex.compile(vocabulary.pattern)
        self.narrow = _narrow_pattern(vocabulary.pattern)
        self.newer = re.compile(f"[{_ranges(vocabulary.newer)}]") if vocabulary.newer else None
        if vocabulary.newer:
            letter, number = (rf"[\p{{{x}}}--[{_ranges(vocabulary.newer)}]]" for x in "LN")
            exact = vocabulary.pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letter}{number}]")
            exact = exact.replace(r"?\p{L}", f"?{letter}").replace(r"?\p{N}", f"?{number}")
            self.exact = regex.compile(exact, regex.V1)
        self.between = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, bytes] = {}

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            end = start + SLICE
            if end < len(text):
                cut = _CUT.search(text, end)
                end = cut.start() if cut else len(text)
            yield text[start:end]
            start = end

    def words(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens between them."""
        at = 0
        marks = self.between.finditer(text) if self.between and any(s in text for s in self.special) else ()
        for mark in marks:
            yield from self._plain_words(text[at : mark.start()])
            yield self.special[mark.group()]
            at = mark.end()
        yield from self._plain_words(text[at:] if at else text)

    def _plain_words(self, text: str) -> Iterator[list[str]]:
        if _is_narrow(text):
            pattern = self.narrow
        else:
            pattern = self.exact if self.newer is not None and self.newer.search(text) else self.plain
        for part in self._slices(text):
            yield pattern.findall(part)

    def learn(self, words: list[str]) -> None:
        """Ids of new words: from the lexicon, all at once; of the others by merging."""
        data = [w.encode() for w in words]
        ranks = self.lexicon.ranks(data) if self.lexicon else np.full(len(data), -1)
        for word, own, rank in zip(words, data, ranks.tolist(), strict=True):
            ids = self.lexicon.output(rank) if rank >= 0 else self.merger.ids(own)
            self.known[word] = np.asarray(ids, dtype=np.int32).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > self.cached_words:
            self.known = {}
        split = [list(self.words(text)) for text in texts]
        new = set().union(*(part for parts in split for part in parts if not isinstance(part, int)))
        self.learn([w for w in new if w not in self.known])
        get = self.known.__getitem__
        return [
            b"".join(np.int32(part).tobytes() if isinstance(part, int) else b"".join(map(get, part)) for part in parts) for parts in split
        ]


def frequent_words(docs: DataFrame, n: int) -> list[str]:
    """At most ``n`` of the most frequent words of all texts. A histogram over classes of frequency (16 per
    doubling, about a thousand rows) gives the least class that still fits; only its words and more
    frequent ones reach the driver."""
    words = docs.filter("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(COUNT_PATTERN), F.lit(0))).alias("word"))
    # Long words are rare ones; left out before the shuffle they take no part of it.
    counts = words.filter(F.length("word") <= LEXICON_CHARS).groupBy("word").agg(F.count("*").alias("n")).filter("n > 2")
    classed = stored(counts.select("word", F.floor(16 * F.log2("n")).cast("int").alias("class")), "bpe-words")
    total, least = 0, None
    for row in sorted(classed.groupBy("class").count().collect(), reverse=True):
        total += row["count"]
        if total > n:
            break
        least = row["class"]
    return [] if least is None else [r.word for r in classed.filter(F.col("class") >= least).select("word").collect()]


def ship_lexicon(spark: SparkSession, vocabulary: Vocabulary, words: list[str]) -> str:
    """Compiles the words and hands the file to Spark, which copies it to every executor; its name."""
    merger = Merger(vocabulary)
    data = sorted({w.encode() for w in words})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="chunkweave-lexicon-"), name)
    with open(path, "wb") as file:
        file.write(build(data, [merger.ids(w) for w in data]))
    spark.sparkContext.addFile(path)
    return name


def _groups(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Rows of a text column in groups of bounded size."""
    at = 0
    while at < len(column):
        size, end, texts = 0, at, []
        while end < len(column) and size < BATCH_CHARS:
            texts.append(column[end].as_py() or "")
            size += len(texts[-1])
            end += 1
        yield at, end, texts
        at = end


def encode_packed(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``packed binary``: the ids of each text as little-endian 16-bit numbers, in the order of the rows.
    Strings of special tokens are ordinary text here."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    if len(vocabulary.tokens) > 1 << 16:
        raise ValueError("ids do not fit 16 bits")
    name = ship_lexicon(spark, vocabulary, frequent_words(docs, lexicon_words))
    state = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = Encoder(state.value, SparkFiles.get(name), with_special=False)
        for batch in batches:
            for _, _, texts in _groups(batch.column(0)):
                found = (np.frombuffer(ids, dtype="<i4").astype("<u2").tobytes() for ids in encoder.encode(texts))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["packed"])

    return docs.select("text").mapInArrow(run, "packed binary")


def encode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``ids array<int>`` of ``text``."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    name = ship_lexicon(spark, vocabulary, frequent_words(docs, lexicon_words))
    state = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = Encoder(state.value, SparkFiles.get(name))
        for batch in batches:
            kept, column = batch.select(list(keep)), batch.column(batch.schema.get_field_index("text"))
            for start, end, texts in _groups(column):
                found = encoder.encode(texts)
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*kept.slice(start, end - start).columns, ids], names=[*keep, "ids"])

    kinds = dict(docs.dtypes)
    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    return wanted.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>"]))


def encode_checked(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``ids array<int>`` of ``text``, and ``round_trip``: whether they decode to the text
    again. Texts pass through one Python worker once."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    name = ship_lexicon(spark, vocabulary, frequent_words(docs, lexicon_words))
    state = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = state.value
        encoder, token = Encoder(vocabulary, SparkFiles.get(name), cached_words=CHECKED_CACHE), vocabulary.tokens.__getitem__
        for batch in batches:
            kept, column = batch.select(list(keep)), batch.column(batch.schema.get_field_index("text"))
            for start, end, texts in _groups(column):
                found = [np.frombuffer(ids, dtype=np.int32) for ids in encoder.encode(texts)]
                same = [b"".join(map(token, ids.tolist())).decode("utf-8", "replace") == text for ids, text in zip(found, texts, strict=True)]
                offsets = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*kept.slice(start, end - start).columns, ids, pa.array(same)], names=[*keep, "ids", "round_trip"])

    kinds = dict(docs.dtypes)
    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    return wanted.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", "round_trip boolean"]))


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id", "ids")) -> DataFrame:
    """The kept columns and ``decoded string`` of ``ids``."""
    state = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path).tokens)

    def run(batches):
        tokens = state.value
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        places, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), dtype=np.uint8)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            at = 0
            while at < batch.num_rows:
                # Some rows at a time: index arrays take 8 bytes per byte of text.
                end, size = at, 0
                while end < batch.num_rows and size < DECODE_IDS:
                    size += len(column[end]) if column[end].is_valid else 0
                    end += 1
                rows = column.slice(at, end - at).fill_null([])
                yield _decoded(batch.select(list(keep)).slice(at, end - at), rows, lengths, places, data)
                at = end

    kinds = dict(encoded.dtypes)
    wanted = encoded.select(*dict.fromkeys([*keep, "ids"]))
    return wanted.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decoded string"]))


def _decoded(kept: pa.RecordBatch, rows: pa.ListArray, lengths: np.ndarray, places: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    ids = rows.flatten().to_numpy(zero_copy_only=False)
    sizes = lengths[ids]
    ends = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(sizes, out=ends[1:])
    pieces = []
    for a in range(0, len(ids), DECODE_IDS):
        own, base = sizes[a : a + DECODE_IDS], ends[a]
        inside = np.arange(ends[min(a + DECODE_IDS, len(ids))] - base) - np.repeat(ends[a : a + len(own)] - base, own)
        pieces.append(data[np.repeat(places[ids[a : a + DECODE_IDS]], own) + inside])
    content = b"".join(p.tobytes() for p in pieces)
    offsets = rows.offsets.to_numpy()
    cuts = ends[offsets - offsets[0]]
    texts = [content[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], names=[*kept.schema.names, "decoded"])


def digests(decoded: DataFrame) -> DataFrame:
    """The contract's columns from real ids and texts."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
