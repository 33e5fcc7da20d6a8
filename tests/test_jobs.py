"""Sources on disk, packets, streams."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from chunkweave.functions.wordbag import word_bag
from chunkweave.operators import search
from chunkweave.operators.packing import ChunkingOptions
from chunkweave.plans import build as B
from chunkweave.sources import files as S
from chunkweave.sources import packets as P
from chunkweave.sources import tables as T
from chunkweave.streaming.incremental import current_chunks, ingest_stream


def as_set(frame):
    return {tuple(r) for r in frame.collect()}


def table(spark, folder, packet, name):
    return P.packet_table(spark, str(folder / packet), name)


SPEC = B.PacketSpec("demo", "1.0", "bag", description="a: b")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, data in {
        "intro.md": "Welcome\nThis is a sample project\nEnd".encode(),
        "code.py": b"def hello():\n    return 42\n",
        "pkg/__init__.py": b"X = 1\r\n",
        ".cfg/note.TXT": "caf\xe9".encode("latin-1"),
        "blank.py": b" \n",
        "data.bin": b"\x00",
        "pkg/deep/utf.rs": "é".encode(),
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def test_scan_reads_all_allowed_files(spark, tree):
    got = {r.path: (r.ext, r.content) for r in S.read_sources(spark, tree).collect()}
    assert got == {
        "intro.md": (".md", "Welcome\nThis is a sample project\nEnd"),
        "code.py": (".py", "def hello():\n    return 42\n"),
        "pkg/__init__.py": (".py", "X = 1\n"),
        ".cfg/note.TXT": (".txt", "café"),
        "blank.py": (".py", " \n"),
        "pkg/deep/utf.rs": (".rs", "é"),
    }
    assert S.non_blank(S.read_sources(spark, tree)).count() == 5
    assert S.read_sources(spark, tree, [".bin"]).count() == 1


def test_build_query_rebuild(spark, tree, tmp_path):
    sources = S.read_sources(spark, tree)
    first = B.build_packet(sources, str(tmp_path / "p1"), SPEC, word_bag(16))
    assert first["counts"] == {"docs": 5, "vectors": 5} and first["incremental"] == {"enabled": False, "reused": 0, "embedded": 5, "removed": 0}
    assert first["package"]["tags"] == ["corpus", "docs", "python", "rust"] and first["embedding"]["normalized"]

    queries = spark.createDataFrame([(1, "sample project"), (2, "return 42")], "query_id int, text string")
    hits = B.query_packet(spark, str(tmp_path / "p1"), queries, word_bag(16), 2, reranker="token-diversity", fetch_k=3)
    top = {r.query_id: r.chunk_id for r in hits.where("rank = 1").collect()}
    assert top == {1: "intro.md:0", 2: "code.py:0"}
    only = B.query_packet(spark, str(tmp_path / "p1"), queries, word_bag(16), 5, metadata={"ext": ".rs"})
    assert {r.chunk_id for r in only.collect()} == {"pkg/deep/utf.rs:0"}

    edited = sources.withColumn("content", F.when(F.col("path") == "code.py", F.lit("new text")).otherwise(F.col("content")))
    again = B.build_packet(edited, str(tmp_path / "p2"), SPEC, word_bag(16), previous=str(tmp_path / "p1"))
    assert again["incremental"] == {"enabled": True, "reused": 4, "embedded": 1, "removed": 1}
    assert table(spark, tmp_path, "p2", "vectors").count() == 5

    wider = B.build_packet(edited, str(tmp_path / "p3"), SPEC, word_bag(8), previous=str(tmp_path / "p1"))
    assert wider["embedding"]["dim"] == 8 and wider["incremental"]["reused"] == 0 and wider["incremental"]["removed"] == 1
    other = B.PacketSpec("demo", "1.1", "other-model")
    redone = B.reembed_packet(spark, str(tmp_path / "p1"), str(tmp_path / "p4"), other, word_bag(4))
    assert redone["embedding"]["model"] == "other-model" and redone["counts"]["docs"] == 5
    assert redone["source"]["file_ext_counts"] == first["source"]["file_ext_counts"]


def test_structural_and_numbered_packets(spark, tree, tmp_path):
    sources = S.read_sources(spark, tree)
    built = B.build_packet(sources, str(tmp_path / "s"), SPEC, word_bag(8), options=ChunkingOptions())
    assert built["counts"]["docs"] == 5
    B.build_packet(sources, str(tmp_path / "n"), SPEC, word_bag(8), numbered=True)
    ids = [r.chunk_id for r in table(spark, tmp_path, "n", "docs").collect()]
    assert sorted(ids) == [".cfg/note.TXT:0", "code.py:1", "intro.md:2", "pkg/__init__.py:3", "pkg/deep/utf.rs:4"]
    with pytest.raises(ValueError, match="no chunks"):
        B.build_packet(sources.limit(0), str(tmp_path / "e"), SPEC, word_bag(8))


def test_enriched_packet_and_rerun(spark, tree, tmp_path):
    def service(request):
        if request["path"].endswith(".rs"):
            raise RuntimeError("down")
        items = [{"id": s["segment_id"], "text": s["text"], "title": "T"} for s in request["segments"]]
        return json.dumps({"chunks": items})

    def silent(request):
        raise AssertionError("must not be asked")

    settings = B.EnrichmentSpec("writer", max_segments_per_request=2)
    sources = S.read_sources(spark, tree, S.CODE_EXTENSIONS + S.TEXT_EXTENSIONS)
    built = B.enrich_packet(sources, str(tmp_path / "e1"), SPEC, word_bag(8), service, settings)
    rows = {r.path: r for r in table(spark, tmp_path, "e1", "docs").collect()}
    assert built["counts"]["docs"] == len(rows) == 5
    assert rows["intro.md"].metadata["title"] == "T" and rows["pkg/deep/utf.rs"].metadata["fallback"] == "true"
    assert built["enrichment"] == {"calls": 4, "file_cache_hits": 0, "segment_cache_hits": 0}

    again = B.enrich_packet(
        sources, str(tmp_path / "e2"), SPEC, word_bag(8), silent, settings, previous=str(tmp_path / "e1")
    )
    assert again["enrichment"] == {"calls": 0, "file_cache_hits": 5, "segment_cache_hits": 4}
    assert again["incremental"] == {"enabled": True, "reused": 5, "embedded": 0, "removed": 0}
    same = {(r.path, r.text) for r in table(spark, tmp_path, "e2", "docs").collect()}
    assert same == {(p, r.text) for p, r in rows.items()}


def test_chunk_lines_round_trip(spark, tmp_path):
    rows = [("doc-1", "hello world", {"path": "foo.txt"}), ("doc-2", "goodbye", {"path": "bar.md"})]
    chunks = spark.createDataFrame(rows, "id string, text string, metadata map<string,string>")
    T.write_chunk_lines(chunks, str(tmp_path / "c"))
    back = T.read_chunk_lines(spark, str(tmp_path / "c"))
    assert {(r.id, r.text, r.metadata["path"]) for r in back.collect()} == {(i, t, m["path"]) for i, t, m in rows}
    assert back.where("id = 'doc-2'").first().hash == chunks.select(F.sha2(F.lit("goodbye"), 256)).first()[0]
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "text": "x"}\n\n{oops\n[1]\n{"id": "b"}\n')
    assert {r.id for r in T.read_chunk_lines(spark, str(tmp_path / "bad.jsonl"), strict=False).collect()} == {"a", "b"}
    with pytest.raises(Exception):
        T.read_chunk_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_vectors_round_trip(spark, tmp_path):
    vectors = spark.createDataFrame([(str(i), [i * 4 + j + 0.1 for j in range(4)]) for i in range(3)], "hash string, vec array<float>")
    T.write_vectors(vectors, str(tmp_path / "v"))
    back = {r.hash: r.vec for r in T.read_vectors(spark, str(tmp_path / "v"), 4).collect()}
    assert all(abs(a - (int(h) * 4 + j + 0.1)) < 1e-2 for h, v in back.items() for j, a in enumerate(v))
    with pytest.raises(Exception, match="expected dim 5"):
        T.read_vectors(spark, str(tmp_path / "v"), 5).collect()


def test_manifests_keep_unknown_keys(spark, tmp_path):
    manifest = {
        "schema_version": "1.0", "packet_id": "test", "embedding": {"model": "m", "dim": 4, "dtype": "float16", "normalized": True},
        "counts": {"docs": 2, "vectors": 2}, "package": {"name": "test", "tags": ["a"]}, "legacy_flag": True,
    }
    (tmp_path / "test/0.0.1").mkdir(parents=True)
    (tmp_path / "test/0.0.1/manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "test/0.0.2").mkdir(parents=True)
    (tmp_path / "test/0.0.2/manifest.json").write_text("{broken")
    rows = {r.dir_version: r for r in T.read_manifests(spark, str(tmp_path)).collect()}
    good = rows["0.0.1"]
    assert good.dir_name == "test" and good.embedding.dim == 4 and good.counts == {"docs": 2, "vectors": 2}
    assert good.extras == {"legacy_flag": "true"} and good.package == {"name": "test", "tags": '["a"]'}
    assert rows["0.0.2"].packet_id is None and rows["0.0.2"].counts == {}


def test_key_value_files(spark, tmp_path):
    (tmp_path / "a.yml").write_text('# c: x\nname: "demo"\n\nbad line\nurl: http://x:1\nname: \'last\'\n: none\n')
    got = {r.key: r.value for r in T.read_key_values(spark, str(tmp_path / "a.yml")).collect()}
    assert got == {"name": "last", "url": "http://x:1"}
    text = spark.range(1).select(T.key_value_text(F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.lit('q: "z"'))).alias("t")).first().t
    assert text == 'a: "q: \\"z\\""\nb: x\n'


def test_registry_tables(spark, tmp_path):
    rows = spark.range(2).select("id", F.concat(F.lit("p"), "id").alias("name"), F.current_timestamp().alias("created_at"))
    T.append_registry(rows, str(tmp_path), "packages")
    T.append_registry(rows, str(tmp_path), "packages")
    assert T.read_registry(spark, str(tmp_path), "packages").count() == 4


def test_manifest_catalogue_overwrites_single_versions(spark, tmp_path):
    write = lambda rows: T.write_manifests(spark.createDataFrame(rows, "name string, version string, docs int"), str(tmp_path / "m"))
    write([("a", "1", 1), ("b", "1", 1)])
    write([("a", "1", 2)])
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert {(r.name, r.docs) for r in rows} == {("a", 2), ("b", 1)}


def test_stream_embeds_only_new_texts(spark, tmp_path):
    calls = []
    out, inbox = str(tmp_path / "out"), tmp_path / "inbox"
    schema = "path string, ext string, content string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        query = ingest_stream(stream, out, SPEC, word_bag(8), str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert query.exception() is None
        calls.append(spark.read.parquet(f"{out}/vectors").count())

    arrive([("a.md", ".md", "one"), ("b.md", ".md", "two"), ("c.md", ".md", "one")])
    arrive([("d.md", ".md", "two"), ("e.md", ".md", "three")])
    assert calls == [2, 3]
    assert spark.read.parquet(f"{out}/chunks").count() == 5
    batch = B.build_packet(spark.read.parquet(str(inbox)), str(tmp_path / "batch"), SPEC, word_bag(8))
    assert batch["counts"]["docs"] == 5
    as_set = lambda rows: {(r.hash, tuple(r.vec)) for r in rows.collect()}
    assert as_set(spark.read.parquet(f"{out}/vectors")) == as_set(table(spark, tmp_path, "batch", "vectors"))


def test_scan_paths_are_cut_below_the_root_only(spark, tmp_path, monkeypatch):
    inner = str(tmp_path).lstrip("/")
    names = ["x.py", f"{inner}/src/y.py", "src/src/z.py", "a b/é.py", ".hid/src/w.py", "d1/d2/d3/.e/q.py"]
    for name in names:
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("1")
    monkeypatch.chdir(tmp_path)
    for root in (str(tmp_path / "src"), f"file://{tmp_path}/src/", f"file:{tmp_path}/src"):
        assert sorted(r.path for r in S.read_sources(spark, root).collect()) == sorted(names)
    assert sorted(r.path for r in S.read_sources(spark, str(tmp_path / "src"), hidden=False).collect()) == sorted(names[:4])


def test_packets_are_rebuilt_in_place_and_survive_failures(spark, tree, tmp_path):
    packet, sources = str(tmp_path / "p"), S.read_sources(spark, tree)
    B.build_packet(sources.unionByName(sources.withColumn("path", F.concat(F.lit("copy/"), "path"))), packet, SPEC, word_bag(8))
    first = P.read_manifest(spark, packet)
    assert first["counts"] == {"docs": 10, "vectors": 5}

    def silent(texts):
        raise AssertionError("must not be asked")

    edited = sources.where("path <> 'code.py'")
    again = B.build_packet(edited, packet, SPEC, silent, previous=packet)
    assert again["incremental"] == {"enabled": True, "reused": 4, "embedded": 0, "removed": 1}
    assert table(spark, tmp_path, "p", "vectors").count() == 4

    with pytest.raises(Exception):  # noqa: B017
        B.build_packet(sources, packet, SPEC, silent, previous=packet)
    assert P.read_manifest(spark, packet) == again and table(spark, tmp_path, "p", "docs").count() == 4

    redone = B.reembed_packet(spark, packet, packet, B.PacketSpec("demo", "1.0", "new"), word_bag(4))
    assert redone["embedding"] | {"normalized": True} == again["embedding"] | {"model": "new", "dim": 4, "normalized": True}
    assert table(spark, tmp_path, "p", "docs").count() == 4
    queries = spark.createDataFrame([(1, "sample project")], "query_id int, text string")
    with pytest.raises(Exception, match="dimensions"):
        B.query_packet(spark, packet, queries, word_bag(8)).collect()
    with pytest.raises(ValueError, match="made with"):
        B.query_packet(spark, packet, queries, word_bag(4), model="bag")
    with pytest.raises(ValueError, match="unknown indexer"):
        B.query_packet(spark, packet, queries, word_bag(4), indexer="tree")
    assert B.query_packet(spark, packet, queries, word_bag(4), model="new").count() == 4
    assert P.drop_former_runs(spark, packet) == 3 and table(spark, tmp_path, "p", "docs").count() == 4

    # vectors lost: nothing is taken from an incomplete build
    broken = P.read_manifest(spark, packet)
    table(spark, tmp_path, "p", "vectors").limit(2).write.parquet(packet + "/runs/half/vectors")
    P.publish_manifest(spark, packet, broken | {"files": broken["files"] | {"vectors": "runs/half/vectors"}})
    assert not B.build_packet(sources, packet, B.PacketSpec("demo", "1.0", "new"), word_bag(4), previous=packet)["incremental"]["enabled"]


def test_built_packets_are_listed(spark, tree, tmp_path):
    sources = S.read_sources(spark, tree)
    for version in ("1.0", "1.1"):
        B.build_packet(sources, str(tmp_path / f"cat/demo/{version}"), B.PacketSpec("demo", version, "bag"), word_bag(4))
    rows = {r.dir_version: r for r in T.read_manifests(spark, str(tmp_path / "cat")).collect()}
    assert set(rows) == {"1.0", "1.1"} and rows["1.1"].package["version"] == "1.1" and rows["1.0"].counts == {"docs": 5, "vectors": 5}


def test_a_path_that_arrives_again_replaces_its_chunks(spark, tmp_path):
    out, inbox = str(tmp_path / "out"), str(tmp_path / "inbox")
    schema = "path string, ext string, content string"

    def long_vectors(texts):
        return [[3.0, 4.0] for _ in texts]

    for rows in ([("a", ".md", "one"), ("b", ".md", "two")], [("a", ".md", "three"), ("a", ".md", "three"), ("b", ".md", " ")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        ingest_stream(stream, out, SPEC, long_vectors, str(tmp_path / "ck")).awaitTermination(120)
    assert [(r.path, r.text) for r in current_chunks(spark, out).collect()] == [("a", "three")]
    assert {tuple(round(x, 2) for x in r.vec) for r in spark.read.parquet(f"{out}/vectors").collect()} == {(0.6, 0.8)}


def test_the_token_counter_of_a_build(spark, tmp_path):
    source = spark.createDataFrame([("a.txt", ".txt", "one two three four\n\nfive six seven eight\n\nnine ten")], "path string, ext string, content string")
    sizes = ChunkingOptions(chunk_tokens=20, overlap_tokens=0)
    by_words = B.build_packet(source, str(tmp_path / "w"), SPEC, word_bag(4), options=sizes)
    by_letters = B.build_packet(source, str(tmp_path / "l"), SPEC, word_bag(4), options=sizes, count=F.length)
    assert by_words["counts"]["docs"] == 1 < by_letters["counts"]["docs"]


def test_queries_are_embedded_once_and_hits_are_fetched_by_filter(spark, tree, tmp_path, monkeypatch):
    packet, asked = str(tmp_path / "p"), tmp_path / "asked"
    asked.mkdir()
    B.build_packet(S.read_sources(spark, tree), packet, SPEC, word_bag(16))
    bag = word_bag(16)

    def counted(texts):
        for text in texts:
            (asked / uuid.uuid4().hex).write_text(text)
        return bag(texts)

    texts = [f"sample project {i}" for i in range(10)]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    expected = None
    limits = [(1_000, 100_000), (0, 100_000), (0, 0)]  # by filter, by broadcast, in two steps
    for filtered, broadcast in limits:
        monkeypatch.setattr(search, "FILTERED_HITS", filtered)
        monkeypatch.setattr(search, "BROADCAST_HITS", broadcast)
        found = B.query_packet(spark, packet, queries, counted, 3)
        rows = as_set(found.select("query_id", "rank", "chunk_id", "score", "text"))
        assert len(rows) == 30 and rows == (expected := expected or rows)
        if filtered:
            assert "In(hash" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters", 1)[1]
    assert sorted(p.read_text() for p in asked.iterdir()) == sorted(texts * len(limits))


def test_many_query_blocks_equal_one(spark):
    vectors = spark.range(300).select(F.col("id").alias("chunk_id"), F.array(*[F.sin(F.col("id") * i).cast("float") for i in range(1, 9)]).alias("vec"))
    queries = vectors.select(F.col("chunk_id").alias("query_id"), "vec")
    one = search.top_k(vectors, queries, 4)
    assert as_set(search.top_k(vectors, queries, 4, query_bytes=40 * 8 * 8)) == as_set(one) and one.count() == 1200


@pytest.mark.parametrize("rising", [False, True])
def test_small_query_blocks_share_passes_over_the_vectors(spark, monkeypatch, rising):
    """38 blocks are 3 passes; parts of few rows, ties and scores that rise to the last row miss nothing."""
    passes, partial = [], search._partial_broadcast
    monkeypatch.setattr(search, "_partial_broadcast", lambda *a: passes.append(len(a[1])) or partial(*a))
    monkeypatch.setattr(search, "PASS_BYTES", 104 * 8 * 8)
    monkeypatch.setattr(search, "SCORED_ROWS", 16)
    size = F.col("id") if rising else F.col("id") % 7
    vectors = spark.range(0, 300, 1, 2).select(F.col("id").alias("chunk_id"), F.array(*[(size * i).cast("float") for i in range(1, 9)]).alias("vec"))
    queries = vectors.select(F.col("chunk_id").alias("query_id"), "vec")
    found = search.top_k(vectors, queries, 4, query_bytes=8 * 8 * 8)
    value = (lambda i: i) if rising else (lambda i: i % 7)
    expected = {
        (q, rank, c)
        for q in range(300)
        for rank, c in enumerate(sorted(range(300), key=lambda c: (-value(q) * value(c), c))[:4], 1)
    }
    assert {(r.query_id, r["rank"], r.chunk_id) for r in found.collect()} == expected
    assert len(passes) == 3 and sum(passes) <= 42
