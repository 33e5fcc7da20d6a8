"""The incremental build of arriving documents: keyed state, replays, edits, removal of former generations."""

import pytest
from pyspark.sql import functions as F

from chunkweave.functions.wordbag import word_bag
from chunkweave.plans.build import PacketSpec
from chunkweave.streaming import incremental as I

SPEC = PacketSpec("demo", "1.0", "bag")
SCHEMA = "path string, ext string, content string, hash string, generation int"


@pytest.fixture
def job(spark, tmp_path):
    """``arrive(rows)`` runs the stream over what has come so far; ``arrive.asked`` lists embedded texts."""
    out, inbox, asked = str(tmp_path / "out"), str(tmp_path / "inbox"), tmp_path / "asked"
    asked.mkdir()
    bag = word_bag(8)

    def counted(texts):
        with open(asked / "texts", "a") as log:
            log.writelines(f"{text}\n" for text in texts)
        return bag(texts)

    def arrive(rows, embedder=counted):
        if rows is not None:
            # columns that the stream has names for itself are no part of a document
            spark.createDataFrame([(*row, "x", 7) for row in rows], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        I.ingest_stream(stream, out, SPEC, embedder, str(tmp_path / "ck")).awaitTermination()

    arrive.asked = lambda: sorted((asked / "texts").read_text().splitlines())
    arrive.out = out
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a Python worker per partition of state
    yield arrive
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def current(spark, out):
    return sorted((r.path or "", r.text, r.generation) for r in I.current_chunks(spark, out).collect())


def vectors(spark, out):
    return sorted(r.hash for r in spark.read.parquet(f"{out}/vectors").collect())


def test_texts_are_embedded_once_over_all_batches_and_no_batch_reads_what_is_stored(spark, job, monkeypatch):
    job([("a", ".md", "one"), ("b", ".md", "two"), ("c", ".md", "one")])
    read = []
    stored = I._stored
    monkeypatch.setattr(I, "_stored", lambda session, path, schema: read.append(path) or stored(session, path, schema))
    job([("a", ".md", "two"), ("d", ".md", "three"), ("b", ".md", "two")])
    assert job.asked() == ["one", "three", "two"]
    assert [path.rsplit("/", 1)[1] for path in read] == ["shape"]
    assert current(spark, job.out) == [("a", "two", 2), ("b", "two", 1), ("c", "one", 1), ("d", "three", 1)]
    assert len(set(vectors(spark, job.out))) == 3 == len(vectors(spark, job.out))


def test_a_document_that_comes_again_unchanged_is_not_written_again(spark, job):
    job([("a", ".md", "one"), ("b", ".md", "two")])
    job([("a", ".md", "one"), ("b", ".txt", "two")])
    rows = spark.read.parquet(f"{job.out}/paths").where("batch_id = 1").collect()
    assert [(r.path, r.generation, r.previous) for r in rows] == [("b", 2, 1)]
    assert current(spark, job.out) == [("a", "one", 1), ("b", "two", 2)]


def test_a_failed_batch_is_done_again(spark, job):
    def broken(texts):
        raise RuntimeError("service down")

    job([("a", ".md", "one"), ("b", ".md", "two")])
    before = current(spark, job.out)
    with pytest.raises(Exception, match="service down"):
        job([("a", ".md", "edited"), ("c", ".md", "new")], broken)
    assert current(spark, job.out) == before
    job(None)
    assert current(spark, job.out) == [("a", "edited", 2), ("b", "two", 1), ("c", "new", 1)]
    assert job.asked() == ["edited", "new", "one", "two"]


def test_a_replay_after_everything_was_written_changes_nothing(spark, job, monkeypatch):
    job([("a", ".md", "one")])
    remove = I._remove

    def fails(session, path):
        if path.endswith("arrived"):
            raise RuntimeError("driver lost")
        remove(session, path)

    monkeypatch.setattr(I, "_remove", fails)
    with pytest.raises(Exception, match="driver lost"):
        job([("a", ".md", "two"), ("b", ".md", "one")])
    monkeypatch.setattr(I, "_remove", remove)
    job(None)
    assert current(spark, job.out) == [("a", "two", 2), ("b", "one", 1)]
    assert len(vectors(spark, job.out)) == 2 and job.asked() == ["one", "two"]


def test_former_generations_are_removed(spark, job):
    assert I.compact(spark, job.out) is None
    job([("a", ".md", "one"), ("b", ".md", "two"), ("c", ".md", "three")])
    job([("a", ".md", "1"), ("b", ".md", " ")])
    expected = [("a", "1", 2), ("c", "three", 1)]
    assert current(spark, job.out) == expected
    assert I.compact(spark, job.out) == 1
    assert current(spark, job.out) == expected
    assert spark.read.parquet(f"{job.out}/base").count() == 2
    assert I._numbers(spark, f"{job.out}/chunks") == [] == I._numbers(spark, f"{job.out}/paths")
    job([("c", ".md", "one"), ("d", ".md", "four")])  # replaces a row of the compacted table; its text was seen before
    expected = [("a", "1", 2), ("c", "one", 2), ("d", "four", 1)]
    assert current(spark, job.out) == expected
    assert I.compact(spark, job.out) == 2 and current(spark, job.out) == expected
    assert I._numbers(spark, f"{job.out}/base") == [2] and I.compact(spark, job.out) is None
    assert job.asked() == ["1", "four", "one", "three", "two"]


def test_nulls_ties_and_many_versions_of_one_path(spark, job):
    rows = [(None, None, "x"), (None, ".md", None), ("n", ".md", None), ("t", None, "same"), ("t", ".a", "same"), ("e", ".md", "")]
    job(rows + [("hot", ".md", f"{i:05d}") for i in range(9000)])
    assert current(spark, job.out) == [("", "x", 1), ("hot", "08999", 1), ("t", "same", 1)]
    exts = {r.path: r.ext for r in I.current_chunks(spark, job.out).select("path", F.col("metadata.ext").alias("ext")).collect()}
    assert exts["t"] == ".a"
    job([(None, ".md", "y"), ("hot", ".md", "0")])
    assert current(spark, job.out) == [("", "y", 2), ("hot", "0", 2), ("t", "same", 1)]
    assert spark.read.parquet(f"{job.out}/paths").count() == 7


def test_paths_of_one_bucket_share_a_call_and_only_theirs_are_looked_up(monkeypatch):
    import pandas as pd

    class Map(dict):
        asked = []

        def exists(self):
            return bool(self)

        def getValue(self, key):
            self.asked.append(key)
            return self.get(key)

        updateValue = dict.__setitem__

    state = I.Generations()
    state.last = Map()
    rows = pd.DataFrame([(3, f"p{i}", None, "x") for i in range(50)] + [(3, None, None, None), (3, "p0", ".md", "y")], columns=["bucket", "path", "ext", "content"])
    first = pd.concat(state.handleInputRows((3,), iter([rows[:20], rows[20:]]), None))
    assert len(first) == 51 == len(state.last) and set(first.generation) == {1} and not Map.asked
    assert first.previous.isna().all() and first.set_index("path").content["p0"] == "y"
    again = pd.DataFrame([(3, "p0", ".md", "z"), (3, "p1", None, "x")], columns=rows.columns)
    second = list(state.handleInputRows((3,), iter([again]), None))
    assert [frame.to_dict("records") for frame in second] == [[{"path": "p0", "ext": ".md", "content": "z", "generation": 2, "previous": 1}]]
    assert sorted(Map.asked) == [("p0",), ("p1",)]


def test_a_batch_stores_what_it_changed_and_settings_are_put_back(spark, job):
    job([("a", ".md", "one")])
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", None) is None
    from pathlib import Path

    assert list(Path(job.out).parent.glob("ck/state/0/*/*.changelog"))
