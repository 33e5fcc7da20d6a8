from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkweave.llm import automaton
from chunkweave.llm.bpe import Encoder, Merger, Vocabulary, _is_narrow, decode, encode
from chunkweave.llm.common import tokenizer_path
from chunkweave.llm.queries import op3_bpe, op10_token_counts
from chunkweave.llm.token_counts import count_tokens, scan_blocks, stitched

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "é", "the", "ing", "'s", "'ll", "1", "23", "!", "<|endoftext|>", "　", "\xa0", "漢", "😀", "ᲊ", "\U00016ea0", "\x1c", "\x85", "ſ", "'", "\t", "\r\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


def test_ids_equal_the_library_on_random_texts(library, vocabulary):
    random.seed(5)
    texts = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(chr(random.choice([random.randint(1, 0x2FFF), random.randint(0x10000, 0x1FFFF)])) for _ in range(80)) for _ in range(200)]
    texts += ["ab" * 2000 + "xyz" * 1500, "q" * 30_000, "", " " * 5000, "x y " * 400_000]
    found = Encoder(vocabulary, None).encode(texts)
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, dtype=np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_and_short_merging_agree(vocabulary):
    merger = Merger(vocabulary)
    random.seed(6)
    for _ in range(200):
        parts = [merger.of_byte[random.choice(b"abetinghso ")] for _ in range(random.randint(1, 60))]
        assert merger._short(list(parts)) == merger._long(list(parts))


def test_automaton_shares_suffixes_and_finds_exactly_its_words(tmp_path):
    random.seed(7)
    words = sorted({bytes(random.choice(b"abc") for _ in range(random.randint(0, 7))) + random.choice([b"", b"ing", b"tion"]) for _ in range(900)})
    outputs = [[i, i + 1][: 1 + i % 2] for i in range(len(words))]
    path = tmp_path / "lexicon"
    path.write_bytes(automaton.build(words, outputs))
    found = automaton.Transducer(str(path))
    assert found.states < sum(map(len, words)) // 4
    strangers = [b"abd", b"in", b"xxx", b"abctio"]
    ranks = found.ranks(words + [s for s in strangers if s not in words])
    assert ranks[: len(words)].tolist() == list(range(len(words))) and (ranks[len(words) :] == -1).all()
    assert [found.output(r).tolist() for r in range(len(words))] == outputs
    path.write_bytes(automaton.build([], []))
    assert automaton.Transducer(str(path)).ranks([b"", b"a"]).tolist() == [-1, -1]


def test_a_lexicon_changes_no_result(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    with_words, without = (encode(docs, PATH, n, keep=("doc_id", "key")).orderBy("doc_id").collect() for n in (1000, 0))
    assert with_words == without and with_words[0].key == "k"


def test_query_equals_the_library(spark, edges, library):
    rows = {r.doc_id: r for r in op3_bpe(spark, edges).collect()}
    for doc in spark.read.parquet(f"{edges}/documents.parquet").collect():
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decoding_ids_that_are_no_text(spark, library):
    rows = [(1, [220, 162, 226, 50256]), (2, []), (3, None), (4, [164, 120])]
    found = {r.n: r.decoded for r in decode(spark.createDataFrame(rows, "n int, ids array<int>"), PATH, keep=("n",)).collect()}
    assert found == {n: library.decode(ids or [], skip_special_tokens=False) for n, ids in rows}


def test_token_counts_equal_the_library(spark, edges):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    rows = {r.doc_id: r.n_tokens for r in op10_token_counts(spark, edges).collect()}
    for doc in spark.read.parquet(f"{edges}/documents.parquet").collect():
        assert rows[doc.doc_id] == len(library.encode(doc.text or "", add_special_tokens=False).ids)


def expected_counts(ids: list[int], end: int) -> list[tuple]:
    found, n = [], 0
    for i in ids:
        if i == end:
            found.append((n, True))
            n = 0
        else:
            n += 1
    return found + ([(n, False)] if n else [])


def test_blocks_are_stitched(spark, tmp_path):
    random.seed(8)
    files = [[random.choice([9, 1, 2, 3, 4, 5]) for _ in range(random.randint(0, 60))] for _ in range(6)] + [[1] * 50, [9] * 20, [1] * 33 + [9], []]
    for i, ids in enumerate(files):
        (tmp_path / f"part-{i:05d}.bin").write_bytes(np.array(ids, dtype="<u2").tobytes())
    rows = count_tokens(spark, str(tmp_path), end_id=9, block_tokens=7).collect()
    for i, ids in enumerate(files):
        own = sorted((r.doc_no, r.n_tokens, r.ended) for r in rows if f"part-{i:05d}" in r.file)
        assert own == [(n, *e) for n, e in enumerate(expected_counts(ids, 9))]


def test_a_file_beyond_two_gigabytes_is_split_over_tasks(spark, tmp_path):
    size, ends = (1 << 30) + 5000, [0, 1 << 20, (1 << 30) + 7]  # ids; a sparse file of zeros
    with open(tmp_path / "part-00000 a%20b.bin", "wb") as file:
        file.truncate(2 * size)
        for at in ends:
            file.seek(2 * at)
            file.write((9).to_bytes(2, "little"))
    blocks = scan_blocks(spark, str(tmp_path), 9, "<u2", 1 << 20).select("block", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.block for r in blocks) == list(range(1025)) and len({r.task for r in blocks}) > 1
    rows = sorted((r.doc_no, r.n_tokens, r.ended) for r in count_tokens(spark, str(tmp_path), end_id=9).collect())
    assert rows == [(0, 0, True), (1, (1 << 20) - 1, True), (2, (1 << 30) + 6 - (1 << 20), True), (3, 4992, False)]


def test_ranges_give_the_same_blocks(spark, tmp_path):
    np.random.default_rng(1).integers(0, 10, 1000).astype("<u2").tofile(tmp_path / "part-0.bin")
    one, many = (sorted(map(tuple, scan_blocks(spark, str(tmp_path), 9, "<u2", 7, n).collect())) for n in (1000, 3))
    assert one == many and len(one) == 143


def test_a_cut_file_is_an_error(spark, tmp_path):
    (tmp_path / "part-0.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends inside an id"):
        count_tokens(spark, str(tmp_path)).collect()


def test_no_blocks(spark):
    assert stitched(spark.createDataFrame([], "file string, block long, ends long, head long, tail long, inner array<long>")).collect() == []


def test_narrow_texts_split_as_the_whole_pattern_does():
    """Texts below U+0100 have a pattern of their own; every pair of such characters must split alike."""
    encoder = Encoder(Vocabulary(PATH), None)
    below = [chr(c) for c in range(256)]
    text = "".join(a + b + "x 's" for a in below for b in below) + " "
    assert encoder.narrow.findall(text) == encoder.plain.findall(text)
    assert all(_is_narrow(t) == (not t or max(t) < "Ā") for t in ("", "a", "\xff\xa0", "aĀ", "\U0001f600"))
    assert encoder.newer.search("a\xffĀ漢") is None
