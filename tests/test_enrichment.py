from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from chunkweave.operators import enrichment as N


def parsed(spark, raw):
    frame = spark.createDataFrame([(raw,)], "raw string")
    chunks = frame.select(N.response_chunks(F.try_parse_json("raw")).alias("c")).first().c
    return None if chunks is None else [(c.id, c.text) for c in chunks]


def test_response_shapes(spark):
    assert parsed(spark, '{"chunks":["a",{"id":"x","text":"b"}, " ", {"text": ""}, 3]}') == [("", "a"), ("x", "b")]
    envelope = {"output": [{"type": "other"}, {"type": "output_json", "json": {"chunks": [{"id": "y", "text": "t"}]}}]}
    assert parsed(spark, json.dumps(envelope)) == [("y", "t")]
    assert parsed(spark, '[{"id":"z","text":"q"}]') == [("z", "q")]
    assert parsed(spark, '{"chunks": {"a": 1}}') is None
    assert parsed(spark, '{"other": []}') is None


def test_open_maps(spark):
    cases = {
        '{"a": "x", "b": 1, "c": {"d": 2}}': {"a": "x", "b": "1", "c": '{"d":2}'},
        '"not-json"': {"raw": "not-json"},
        '"{\\"k\\": \\"v\\"}"': {"k": "v"},
        '"[1]"': {},
        '" "': {},
        '["path"]': {"items": '["path"]'},
        '[["a", "b"], ["c", 1]]': {"a": "b", "c": "1"},
        "[]": {},
        "null": {},
        "5": {},
    }
    frame = spark.createDataFrame([(c,) for c in cases], "raw string")
    for row in frame.select("raw", N.coerce_map(F.try_parse_json("raw")).alias("m")).collect():
        assert row.m == cases[row.raw], row.raw


def test_json_recovery(spark):
    cases = {
        '{"k": 1}': 1,
        'x\n```JSON\n{"k": 2}\n``` y': 2,
        '```\nnope\n```\n```\n{"k": 3}\n```': 3,
        'so {"k": 4} then': 4,
        "nothing": None,
        "{broken": None,
    }
    frame = spark.createDataFrame([(c,) for c in cases], "raw string")
    got = frame.select("raw", F.try_variant_get(N.recover_json(F.col("raw")), "$.k", "int").alias("k")).collect()
    assert {r.raw: r.k for r in got} == cases


def test_chat_text(spark):
    parts = json.dumps({"choices": [{"message": {"content": [{"text": "a"}, {"x": 1}, {"text": "b"}]}}]})
    whole = json.dumps({"choices": [{"message": {"content": "c"}}]})
    frame = spark.createDataFrame([(parts,), (whole,)], "raw string")
    assert [r.t for r in frame.select(N.chat_text(F.try_parse_json("raw")).alias("t")).collect()] == ["a\nb", "c"]


def test_classification(spark):
    rows = [
        ("Sample.java", "class A {}", ("java", "java")),
        ("unknown.foo", "plain text", ("text", "text")),
        ("run", "  #!/usr/bin/env python3\n", ("code_generic", "python")),
        ("go", "#!/bin/sh\n", ("text", "shell")),
        ("perl", "#!/usr/bin/perl\n", ("text", "text")),
        ("x.bin", "a\x00b", ("binary_unsupported", "binary")),
        ("D.MD", "x", ("markdown", "markdown")),
    ]
    frame = spark.createDataFrame([(p, c) for p, c, _ in rows], "path string, content string")
    got = {r.path: (r.pipeline, r.language, r.is_supported_text) for r in N.classify(frame).collect()}
    assert got == {p: (*kind, kind[0] != "binary_unsupported") for p, _, kind in rows}


def test_segment_key_is_the_hash_of_sorted_json(spark):
    segment = ("p:k:1:abc", "k", 'say "hi"\n\\ é', 1, 3, None)
    frame = spark.createDataFrame([segment], "segment_id string, kind string, text string, start_line int, end_line int, symbol string")
    payload = {
        "segment": {"id": segment[0], "kind": "k", "text": segment[2], "start": 1, "end": 3, "symbol": None, "metadata": {}},
        "model": "m",
        "prompt_version": "v",
        "constraints": {"max_chunk_tokens": 800, "min_chunk_tokens": 120, "max_segments_per_request": 8},
    }
    expected = hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert frame.select(N.segment_cache_key("m", "v").alias("k")).first().k == expected


def segments(spark, n, language="java"):
    rows = [("f", ".java", language, "text/x-java", i, f"s{i}", "method", f"text {i}", i + 1, i + 1, f"sym{i}") for i in range(n)]
    return spark.createDataFrame(rows, "path string, ext string, language string, mime string, seg_no int, segment_id string, kind string, text string, start_line int, end_line int, symbol string")


def test_requests_are_bounded_and_ordered(spark):
    got = sorted(N.request_batches(segments(spark, 19), 8).collect(), key=lambda r: r.batch)
    assert [[s.seg_no for s in r.segments] for r in got] == [list(range(0, 8)), list(range(8, 16)), [16, 17, 18]]


def test_answers_are_aligned_and_completed(spark):
    def service(request):
        items = [{"id": "s1", "text": " by id ", "tags": ["own"], "anchors": {"path": "other"}}, {"text": "by place", "summary": "given"}]
        return json.dumps({"chunks": [items[1], items[0], "third", "fourth"]})

    answers = N.answered_chunks(N.call_enricher(N.request_batches(segments(spark, 3)), service))
    chunks = answers.first().chunks
    assert [c.id for c in chunks] == ["s0", "s1", "s2", "f:chunk:3"]
    assert chunks[0].tags == ["java", "method", "x-java"] and chunks[0].summary == "given"
    assert chunks[0].anchors == {"path": "f", "start_line": "1", "end_line": "1"}
    assert chunks[1].text == "by id" and chunks[1].anchors["path"] == "other" and chunks[1].anchors["start_line"] == "2"
    assert chunks[2].summary == "third" and chunks[3].anchors == {"path": "f"}
    assert chunks[3].tags == ["java", "x-java"]


def test_failed_requests_fall_back(spark):
    def service(request):
        if request["batch"] == 0:
            raise RuntimeError("down")
        return "no json"

    answers = N.answered_chunks(N.call_enricher(N.request_batches(segments(spark, 10)), service)).collect()
    assert all(a.fallback for a in answers)
    first = [c for a in answers for c in a.chunks if c.id == "s0"][0]
    assert first.metadata == {"fallback": "true"} and first.text == "text 0" and first.tags == []


def test_validation_and_warnings(spark):
    rows = [([("a", "x", "", "s", ["t"], {"path": "p"}, {}, {}), ("a", "y", "", "", [], {}, {}, {}), ("", "z", "", "", [], {}, {}, {}), ("b", " ", "", "", [], {}, {}, {}), ("c", "w", "", "", [], {}, {}, {"m": "1", "path": "old"})],)]
    frame = spark.createDataFrame(rows, f"chunks array<{N.ENRICHED}>")
    assert [c.text for c in frame.select(N.valid_chunks(F.col("chunks")).alias("v")).first().v] == ["x", "w"]
    got = frame.select(N.chunk_warnings(F.col("chunks")).alias("w")).first().w
    assert [(w.id, w.warning) for w in got] == [
        ("a", "dropped: duplicate id"), ("", "dropped: missing id"), ("b", "dropped: empty text"),
        ("c", "no anchors.path"), ("c", "empty summary"), ("c", "empty tags"),
    ]
    files = frame.select(F.lit("f.md").alias("path"), F.lit(".md").alias("ext"), "chunks")
    last = sorted(N.explode_enriched(files).collect(), key=lambda r: r.ord)[-1]
    assert last.metadata["m"] == "1" and last.metadata["path"] == "f.md" and last.metadata["tags"] == "[]"


def test_cache_migration(spark):
    old = spark.createDataFrame([("f", "h", [" a ", " ", "b"])], "path string, source_hash string, chunks array<string>")
    row = N.migrate_file_cache(old).first()
    assert row.pipeline == "legacy" and [(s.segment_id, s.text) for s in row.segments] == [("f:legacy:0", "a"), ("f:legacy:2", "b")]


def test_summary_is_cut_with_an_ellipsis(value):
    assert value(N.default_summary, "t string", " a\n b ") == "a b"
    long = value(N.default_summary, "t string", "word " * 60)
    assert len(long) <= 180 and long.endswith("…") and not long.endswith(" …")


def test_reordered_and_shortened_answers_stay_with_their_segments(spark):
    def service(request):
        items = [{"id": s["segment_id"], "text": "new " + s["segment_id"]} for s in reversed(request["segments"])]
        return json.dumps({"chunks": items[:-1]})

    rows = segments(spark, 3).withColumn("cache_key", F.concat(F.lit("key"), F.col("seg_no").cast("string")))
    answers = N.answered_chunks(N.call_enricher(N.request_batches(rows), service))
    placed = {r.seg_no: (r.chunk.text, r.cache_key, r.fallback) for r in N.placed_chunks(answers).collect()}
    assert placed == {0: ("text 0", "key0", True), 1: ("new s1", "key1", False), 2: ("new s2", "key2", False)}
    assert {r.cache_key: r.chunk.text for r in N.enrichment_cache(N.placed_chunks(answers)).collect()} == {"key1": "new s1", "key2": "new s2"}
    assert [c.id for c in N.file_chunks(answers).first().chunks] == ["s0", "s1", "s2"]


def test_requests_cut_inside_the_row_equal_those_of_rows(spark):
    item = "struct<id:string,kind:string,text:string,start_line:int,end_line:int,symbol:string>"
    files = spark.createDataFrame(
        [(f"f{n}", ".x", "l", "m", [(f"s{i}", "k", f"t{i}", i, i, None) for i in range(n)]) for n in (0, 1, 4, 5, 11)],
        f"path string, ext string, language string, mime string, segments array<{item}>",
    )
    exploded = files.select("path", "ext", "language", "mime", F.posexplode("segments").alias("seg_no", "s")).select(
        "path", "ext", "language", "mime", "seg_no", F.col("s.id").alias("segment_id"), "s.kind", "s.text", "s.start_line", "s.end_line", "s.symbol"
    )
    order = lambda frame: sorted(map(tuple, frame.select("path", "ext", "language", "mime", "batch", "segments").collect()), key=str)
    assert order(N.file_requests(files, 4)) == order(N.request_batches(exploded, 4))


def test_the_service_gets_requests_some_at_a_time(spark, tmp_path):
    """A batch of many requests is never held whole as Python objects."""
    item = F.struct(
        F.lit(0).alias("seg_no"), F.lit("s").alias("segment_id"), F.lit("k").alias("kind"), F.repeat(F.lit("x"), 20_000).alias("text"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("cache_key"),
    )
    requests = spark.range(0, 1_000, 1, 1).select(F.col("id").cast("string").alias("path"), F.array(item).cast(N.SEGMENTS).alias("segments"))

    def service(request):
        import gc

        held = sum(isinstance(o, dict) and o.get("path") is not None and "segments" in o for o in gc.get_objects())
        if request["path"] == "999":
            raise ValueError("no answer")
        return str(held) if request["path"] in ("0", "500", "998") else type(request["segments"]).__name__

    raw = {r.path: r.raw for r in N.call_enricher(requests, service).select("path", "raw").collect()}
    assert len(raw) == 1_000 and raw["999"] is None and raw["1"] == "list"
    assert all(0 < int(raw[p]) <= 64 for p in ("0", "500", "998"))


def test_unchanged_files_are_not_cut_into_segments_twice(spark, monkeypatch):
    from chunkweave.plans import enrich_checks as Q
    from chunkweave.plans import inputs as In

    def files(*rows):
        return In.with_source_hash(spark.createDataFrame([(path, ".txt", text) for path, text in rows], "path string, ext string, content string"))

    cut, keyed = [], Q._keyed_segments
    monkeypatch.setattr(Q, "_keyed_segments", lambda rows: cut.append(sorted(r.path for r in rows.collect())) or keyed(rows))
    now = files(("a.txt", "one\n\ntwo"), ("b.txt", "three\n\nfour"), ("new.txt", "five"))
    before = files(("a.txt", "one\n\ntwo"), ("b.txt", "three\n\nedited"), ("gone.txt", "six"))
    hits = {(r.path, r.seg_no): r.segment_hit for r in Q._segment_hits(now, before).collect()}
    assert cut == [["a.txt", "b.txt", "new.txt"], ["b.txt", "gone.txt"]]
    old = {r.cache_key for r in keyed(before).collect()}
    assert hits == {(r.path, r.seg_no): r.cache_key in old for r in keyed(now).collect()}
    assert {path for (path, _), hit in hits.items() if hit} >= {"a.txt"} and not hits["new.txt", 0]
