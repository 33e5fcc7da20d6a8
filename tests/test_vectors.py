from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkweave.functions import vectors as V
from chunkweave.functions.wordbag import word_bag
from chunkweave.operators import embedding as E
from chunkweave.operators.skew import spread_join
from chunkweave.plans import build_checks
from chunkweave.sources import tables as T


def test_l2_normalize(value):
    assert value(V.l2_normalize, "v array<float>", [3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert value(V.l2_normalize, "v array<float>", [0.0, 0.0]) == [0.0, 0.0]


def test_half_precision_equals_numpy(value):
    rnd = random.Random(2)
    xs = [float(np.float32(rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 6))) for _ in range(3000)]
    xs += [0.0, 65504.0, 65519.0, 65520.0, 6e-8, 2.9e-8, -1.0]
    with np.errstate(over="ignore"):
        expected = np.array(xs, dtype="f4").astype("f2").astype("f4")
    got = np.array(value(V.half_precision, "v array<float>", xs), dtype="f4")
    assert (got == expected).all()


def test_violations(spark):
    rows = [(1, [0.0, 1.0]), (2, [float("nan"), 2.0]), (3, [1.0]), (4, []), (5, [float("inf"), 0.0])]
    frame = spark.createDataFrame(rows, "id int, vec array<float>")
    found = {r.id: r.problem for r in E.vector_violations(frame, 2).collect()}
    assert found == {2: "non_finite", 3: "dimension", 4: "empty", 5: "non_finite"}
    with pytest.raises(Exception, match="bad vector"):
        E.checked_vectors(frame, 2).collect()


def test_normalisation_modes(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0])], "id int, vec array<float>")
    got = {r.id: [round(x, 6) for x in r.vec] for r in E.normalize_table(frame, "auto").collect()}
    assert got == {1: [1.0, 0.0], 2: [0.6, 0.8]}
    assert E.normalize_table(frame, "server").where("id = 2").first().vec == [3.0, 4.0]
    unit = frame.where("id = 1")
    assert E.unit_check(unit).first().is_normalized
    assert E.normalize_table(unit, "auto").first().vec == [1.0, 0.0]
    with pytest.raises(ValueError):
        E.normalize_table(frame, "other")


def test_response_order(spark):
    rows = [(1, [(1, [0.0, 1.0]), (0, [1.0, 0.0])]), (2, [(1, [0.0]), (2, [1.0])])]
    frame = spark.createDataFrame(rows, "id int, data array<struct<index:int,embedding:array<double>>>")
    got = {r.id: r.v for r in frame.select("id", E.ordered_response(F.col("data")).alias("v")).collect()}
    assert got == {1: [[1.0, 0.0], [0.0, 1.0]], 2: None}


def test_batches_and_row_count_of_the_embedder(spark):
    texts = spark.createDataFrame([(str(i), f"t{i}") for i in range(7)], "hash string, text string").coalesce(1)

    def sizes(batch):
        return np.full((len(batch), 4), len(batch), dtype="f4")

    got = [r.vec for r in E.embed_texts(texts, sizes, batch_texts=3).collect()]
    assert sorted(v[0] for v in got) == [1, 3, 3, 3, 3, 3, 3] and all(len(v) == 4 for v in got)
    with pytest.raises(Exception, match="texts"):
        E.embed_texts(texts, lambda batch: np.zeros((1, 2)), batch_texts=3).collect()


def test_reuse(spark):
    chunks = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b"), ("h3", "c")], "hash string, text string")
    cache = spark.createDataFrame([("h1", [1.0]), ("h9", [2.0])], "hash string, vec array<float>")
    counts = E.reuse_counts(chunks, cache).first()
    assert (counts.new_chunks, counts.reused, counts.to_embed, counts.removed) == (4, 2, 2, 1)
    assert counts.reused + counts.to_embed == counts.new_chunks
    assert {r.hash for r in E.missing_texts(chunks, cache).collect()} == {"h2", "h3"}
    assert [r.hash for r in E.removed_hashes(chunks, cache).collect()] == ["h9"]
    vectors = E.incremental_vectors(chunks, cache, word_bag(4)).collect()
    assert {(r.hash, r.reused) for r in vectors} == {("h1", True), ("h2", False), ("h3", False)}


def test_first_by_hash_skips_short_hashes(spark):
    long = "x" * 40
    rows = [(long, 2, [2.0]), (long, 1, [1.0]), ("short", 0, [0.0])]
    got = E.first_by_hash(spark.createDataFrame(rows, "hash string, ord int, vec array<float>")).collect()
    assert [(r.hash, r.vec) for r in got] == [(long, [1.0])]


def test_cache_rules():
    manifest = {"embedding": {"model": "m", "max_seq_length": 8}}
    assert E.cache_matches(manifest, "m", 8, 3, 3)
    assert not E.cache_matches(manifest, "m", 9, 3, 3)
    assert not E.cache_matches(manifest, "n", 8, 3, 3)
    assert not E.cache_matches(manifest, "m", 8, 3, 2)
    assert E.cache_matches({"embedding": {"model": "m"}}, "m", 9, 3, 3)


def test_spread_join_equals_plain_join_on_a_hot_key(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 7 else "hot" if i % 3 else f"k{i}") for i in range(3000)], "i int, k string")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    for how in ("left", "inner"):
        plain = sorted(rows.join(lookup, "k", how).select("i", "k", "v").collect(), key=lambda r: r.i)
        assert sorted(spread_join(rows, lookup, "k", how).select("i", "k", "v").collect(), key=lambda r: r.i) == plain
    with pytest.raises(ValueError, match="repeat"):
        spread_join(rows, lookup, "k", "right")


def test_a_cache_laid_out_by_hash_does_not_move(spark, tmp_path):
    """Neither a join nor a grouping on the hash shuffles the cache; another session finds the layout, too."""
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.array(F.lit(0.5).cast("float")).alias("vec"))
    path = str(tmp_path / "cache")
    T.write_by_hash(rows, path, "hash", 6)
    new = spark.range(4000, 6000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    for session in (spark, spark.newSession()):
        session.sql(f"DROP TABLE IF EXISTS {T._bucketed_name(path)}")
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            cache = T.read_by_hash(session, path, "hash string, vec array<float>", "hash", 6)
            found = cache.join(session.createDataFrame(new.collect(), "hash string"), "hash", "left_semi")
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and found.count() == 1000
            assert cache.count() == 5000 and "Exchange hash" not in cache.groupBy("hash").count()._jdf.queryExecution().executedPlan().toString()
        finally:
            session.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cache_reuse_moves_only_chunks(spark):
    plan = build_checks.cache_reuse(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "SelectedBucketsCount" in line or "Bucketed: true" in line]
    assert scans  # the merge join reads the cache as it lies
