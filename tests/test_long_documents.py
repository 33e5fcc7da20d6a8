"""Documents as rows of lines against the folds over whole texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chunkweave.functions.text import char_estimate
from chunkweave.operators.constraints import oversize_parts
from chunkweave.operators.long_documents import pack_long_lines, read_long_lines, split_long_lines
from chunkweave.operators.packing import micro_split


def document(seed: int, n: int, blank: float) -> list[str]:
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        if rng.random() < blank:
            found.append(rng.choice(["", "  ", "\t"]))
        else:
            found.append(" " * rng.randrange(3) + " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([1, 2, 5, 30]))) + " " * rng.randrange(2))
    return found


def documents() -> dict[str, list[str]]:
    found = {f"d{i}": document(i, n, blank) for i, (n, blank) in enumerate([(400, 0.2), (1, 0), (3, 0), (150, 0.8), (60, 0), (7, 0.3)])}
    found["gap"] = ["start here", *[""] * 300, "after a gap", *["  "] * 90, "and one more"]
    found["blank"] = ["", " ", "\t"] * 40
    found["leading"] = [""] * 150 + document(9, 80, 0.1) + [" "] * 70
    return found


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(doc, i, text) for doc, texts in documents().items() for i, text in enumerate(texts)]
    rows += [(None, 1, "of no document"), ("d1", None, "nowhere"), ("null", 0, None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc string, position long, text string").repartition(7)


def by_fold(spark, build):
    rows = [(doc, "\n".join(texts)) for doc, texts in documents().items()]
    parts = spark.createDataFrame(rows, "doc string, text string").select("doc", build(F.col("text")).alias("parts"))
    return {r.doc: r.parts for r in parts.collect() if r.parts}


def by_rows(parts):
    found = {}
    for row in parts.orderBy("doc", "ord").collect():
        found.setdefault(row.doc, []).append(row.text)
        assert row.ord == len(found[row.doc]) - 1
    return found


@pytest.mark.parametrize(("target", "overlap", "block", "fan"), [(12, 0, 13, 2), (12, 5, 16, 3), (40, 39, 41, 2), (220, 40, 1 << 16, 256), (1, 0, 4, 2)])
def test_packing_equals_the_fold(spark, lines, target, overlap, block, fan):
    expected = by_fold(spark, lambda t: micro_split(t, target_tokens=target, overlap_tokens=overlap))
    assert by_rows(pack_long_lines(lines, target_tokens=target, overlap_tokens=overlap, block_lines=block, fan=fan)) == expected


@pytest.mark.parametrize(("most", "block", "fan"), [(3, 8, 2), (10, 50, 3), (800, 1 << 16, 256)])
def test_splitting_equals_the_fold(spark, lines, most, block, fan):
    expected = by_fold(spark, lambda t: oversize_parts(t, most))
    assert by_rows(split_long_lines(lines, most, block_lines=block, fan=fan)) == expected


def test_other_counts_and_counts_of_nothing(spark, lines):
    expected = by_fold(spark, lambda t: micro_split(t, target_tokens=30, overlap_tokens=7, count=char_estimate))
    assert by_rows(pack_long_lines(lines, target_tokens=30, overlap_tokens=7, count=char_estimate, block_lines=40, fan=2)) == expected
    with pytest.raises(Exception, match="less than one token"):
        pack_long_lines(lines, count=lambda t: F.lit(0)).collect()


def test_one_file_split_over_tasks(spark, tmp_path):
    texts = document(5, 20_000, 0.1)
    (tmp_path / "long.txt").write_text("\n".join(texts))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        lines = read_long_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        found = pack_long_lines(lines, target_tokens=100, overlap_tokens=20, block_lines=1000, fan=4).orderBy("ord").collect()
    finally:
        spark.conf.set(key, before)
    whole = spark.createDataFrame([("\n".join(texts),)], "text string")
    assert [r.text for r in found] == whole.select(micro_split(F.col("text"), target_tokens=100, overlap_tokens=20).alias("p")).first().p


def test_documents_of_one_block_are_no_groups(spark):
    lines = spark.range(3000).selectExpr("cast(id div 10 AS string) AS doc", "id AS position", "concat('line ', id) AS text")
    parts = split_long_lines(lines, 8)
    assert "InArrow" in (plan := parts._jdf.queryExecution().executedPlan().toString())
    assert "FlatMap" not in plan
    assert parts.count() > 300 and parts.where("doc = '7' AND ord = 0").first().text.startswith("line 70\n")
