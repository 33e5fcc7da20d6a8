from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chunkweave.functions import text as T
from chunkweave.functions.arrays import first_of_each, running_sums
from chunkweave.operators.windows import first_numbers, line_windows, number_chunks

ALPHABET = ["a", "bc", " ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "é", "#", "{"]


def random_texts(n=300, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_primitives_follow_python(spark):
    texts = random_texts()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select(
        "i",
        T.strip(F.col("t")).alias("strip"),
        T.rstrip(F.col("t")).alias("rstrip"),
        T.split_lines(F.col("t")).alias("lines"),
        T.split_words(F.col("t")).alias("words"),
        T.word_count(F.col("t")).alias("n"),
        T.char_estimate(F.col("t")).alias("estimate"),
    ).collect()
    for row in rows:
        t = texts[row.i]
        assert row.strip == t.strip()
        assert row.rstrip == t.rstrip()
        assert row.lines == t.splitlines()
        assert row.words == t.split()
        assert row.n == (max(1, len(t.split())) if t else 0)
        assert row.estimate == (max(1, len(t.strip()) // 4) if t.strip() else 0)


def test_path_suffix(spark):
    from pathlib import PurePosixPath

    paths = ["a/b.PY", "a/.bashrc", "x.tar.gz", "noext", "d.d/file", "a/..x"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.path_suffix(F.col("p")).alias("s"))
    for row in rows.collect():
        assert row.s == PurePosixPath(row.p).suffix.lower()


@pytest.mark.parametrize("width,overlap", [(1, 0), (4, 1), (3, 0), (5, 9), (0, 2), (80, 10)])
def test_windows_cover_all_lines(spark, width, overlap):
    texts = ["\n".join(f"line{i}" for i in range(n)) for n in range(0, 25)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", line_windows(F.col("t"), width, overlap).alias("w")).collect():
        lines = row.t.splitlines()
        size = width if width > 0 else max(len(lines), 1)
        step = max(size - max(min(overlap, size - 1), 0), 1)
        starts = [0] if lines else []
        while starts and starts[-1] + size < len(lines):
            starts.append(starts[-1] + step)
        assert row.w == ["\n".join(lines[s : s + size]) for s in starts]


def test_numbers_do_not_depend_on_ranges(spark):
    paths = [f"{d}/{f}.py" for d in ("a", "a-b", "a b", "b") for f in range(30)] + ["a.py", "z.py"]
    chunks = spark.createDataFrame([(p, o) for p in paths for o in range(len(p) % 4)], "path string, ord int")
    expected = {}
    for number, (path, ord_) in enumerate(
        sorted(((p, o) for p in paths for o in range(len(p) % 4)), key=lambda x: (x[0].split("/"), x[1]))
    ):
        expected[path, ord_] = number
    for ranges in (1, 7):
        rows = number_chunks(chunks, ranges).collect()
        assert {(r.path, r.ord): r.number for r in rows} == expected
    per_file = spark.createDataFrame([("b/x", 2), ("a/z", 3)], "path string, n_chunks long")
    assert {r.path: r.first_number for r in first_numbers(per_file).collect()} == {"a/z": 0, "b/x": 3}


def test_running_sums_and_first_of_each(value):
    numbers = [i % 5 for i in range(3000)]
    got = value(running_sums, "v array<int>", numbers)
    assert got == [sum(numbers[:i]) for i in range(0, 20)] + got[20:]
    assert got[-1] == sum(numbers[:-1]) and len(got) == 3000
    items = ["b", "a", "b", "c", "a"]
    assert value(lambda c: first_of_each(c, lambda x: x), "v array<string>", items) == ["b", "a", "c"]


def test_small_projections(value):
    assert value(T.safe_segment, "v string", " a/b\\c  d!e- ") == "a-b-c-d-e"
    assert value(T.display_line, "v string", "x\n" + "y" * 200) == "x " + "y" * 155 + "..."
    assert value(T.optional_bool, "v string", " Off ") is False
    assert value(T.optional_bool, "v string", "yes") is True
    assert value(T.optional_bool, "v string", "") is None
    assert value(T.glob_match, "a string, b string", "jina/base.v2", "jina/*.v?") is True
    assert value(T.glob_match, "a string, b string", "jina/baseXv2", "jina/*.v?") is False
    assert value(T.glob_match, "a string, b string", "m-b", "m-[!a]") is True


def test_globs_equal_the_standard_library(spark):
    import random
    from fnmatch import fnmatchcase

    random.seed(11)
    alphabet = "ab-[]!*?^.\\&z1"
    pairs = [("".join(random.choices(alphabet, k=random.randint(0, 5))), "".join(random.choices(alphabet, k=random.randint(0, 6)))) for _ in range(4000)]
    pairs += [(v, p) for v in ("a", ".", "[", "gpt[", "a?", "-", "&", "b&c", "ab", "\n") for p in ("[*]", "a[?]", "gpt[", "[[]", "[a-c]", "[!a-c]", "[z-a]", "[!z-a]", "[&&a]", "[a&&b]", "[]-a]", "[!]]", "*", "?")]
    rows = spark.createDataFrame(pairs, "v string, p string").select("v", "p", T.glob_match(F.col("v"), F.col("p")).alias("m")).collect()
    wrong = [(r.v, r.p, r.m) for r in rows if r.m != fnmatchcase(r.v, r.p)]
    assert not wrong, wrong[:10]
