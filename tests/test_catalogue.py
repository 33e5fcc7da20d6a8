from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from chunkweave.functions.versions import compare_keys, sort_text, version_key, version_parts
from chunkweave.operators import catalogue as C
from chunkweave.operators import integrity as I

ASCENDING = [
    "1.0-dev", "1.0-alpha", "1.0-alpha-3", "1.0-b2", "1.0-beta-10", "1.0-pre", "1.0-rc1", "1.0-rc2", "1.0-post",
    "1.0-ga", "1.0-final", "1.0", "1.0.1", "1.2", "1.10", "x",
]


def test_version_order(spark):
    frame = spark.createDataFrame([(v,) for v in reversed(ASCENDING)], "v string")
    assert [r.v for r in frame.orderBy(version_key(F.col("v"))).collect()] == ASCENDING


def test_compare_is_antisymmetric(spark):
    pairs = list(itertools.product(ASCENDING[::3], repeat=2))
    frame = spark.createDataFrame(pairs, "a string, b string")
    order = {v: i for i, v in enumerate(ASCENDING)}
    for r in frame.select("a", "b", compare_keys(version_key(F.col("a")), version_key(F.col("b"))).alias("c")).collect():
        assert r.c == (order[r.a] > order[r.b]) - (order[r.a] < order[r.b])


def test_version_parts(value):
    assert value(version_parts, "v string", " 1..0 !a.-. ") == ["1", "0-a"]


def resolved(spark, versions, pinned, target):
    catalogue = spark.createDataFrame([("demo", v) for v in versions], "name string, version string")
    pins = spark.createDataFrame([("demo", pinned, None)], "name string, pinned string, active string")
    request = spark.createDataFrame([(1, "demo", target)], "request_id int, name string, target string")
    row = C.resolve(request, catalogue, pins).first()
    return row.version, row.status


def test_resolution(spark):
    versions = ["1.0.0", "1.1.0", "1.2.0-beta"]
    assert resolved(spark, versions, "1.0.0", None) == ("1.0.0", "ok")
    assert resolved(spark, versions, "1.0.0", "latest") == ("1.2.0-beta", "ok")
    assert resolved(spark, versions, "9.9.9", " ") == ("1.2.0-beta", "ok")
    assert resolved(spark, versions, "1.0.0", "1.1.0") == ("1.1.0", "ok")
    assert resolved(spark, versions, "1.0.0", "3.0") == (None, "not installed")


def test_prune(spark):
    versions = spark.createDataFrame([("demo", v) for v in ("0.9.0", "1.0.0", "1.1.0", "1.2.0")], "name string, version string")
    pins = spark.createDataFrame([("demo", "1.1.0", "0.9.0")], "name string, pinned string, active string")
    assert [r.version for r in C.prune_plan(versions, pins, 1).collect()] == ["1.0.0"]
    with pytest.raises(ValueError):
        C.prune_plan(versions, pins, 0)


def test_specs(spark):
    frame = spark.createDataFrame([("a@1.0",), (" b ",), ("c@",)], "s string")
    name, version = C.parse_spec(F.col("s"))
    assert [(r.n, r.v) for r in frame.select(name.alias("n"), version.alias("v")).collect()] == [
        ("a", "1.0"), ("b", None), ("c", None),
    ]


def test_publish_over_a_yanked_version_conflicts(spark):
    current = spark.createDataFrame([("a", "1", True)], "name string, version string, yanked boolean")
    incoming = spark.createDataFrame([(1, "a", "1", 5), (2, "b", "1", 5), (3, "b", "1", 5), (4, "c", "1", 0)], "upload_id int, name string, version string, size_bytes int")
    got = {r.upload_id: r.outcome for r in C.publish(current, incoming).collect()}
    assert got == {1: "conflict", 2: "created", 3: "repeated", 4: "empty"}
    over = {r.upload_id: r.outcome for r in C.publish(current, incoming, overwrite=True).collect()}
    assert over[1] == "replaced"


def test_model_choice(spark):
    providers = spark.createDataFrame([("p2", ["model-b", "model-c"], None), ("p1", ["model-a"], "model-z"), ("p3", [], "only")], "provider string, models array<string>, default_model string")
    rows = [(1, "model-c", "model-a", []), (2, None, "unknown", []), (3, None, None, ["model-[bc]"]), (4, None, None, []), (5, None, None, ["x*"]), (6, "model-z", None, []), (7, None, None, ["only"])]
    requests = spark.createDataFrame(rows, "packet_id int, requested string, recommended string, patterns array<string>")
    got = {r.packet_id: (r.model, r.provider) for r in C.choose_models(requests, providers).collect()}
    assert got == {1: ("model-c", "p2"), 2: ("unknown", "p1"), 3: ("model-b", "p2"), 4: ("model-a", "p1"), 5: (None, "p1"), 6: ("model-z", "p1"), 7: ("only", "p3")}


def test_patterns_meet_values_by_their_literal_ends(spark):
    import random
    from fnmatch import fnmatchcase

    draw = random.Random(5)
    word = lambda letters, n: "".join(draw.choice(letters) for _ in range(draw.randrange(n)))
    values = sorted({word("ab-1]", 7) for _ in range(120)} | {"", "m" * 40, "m" * 39 + "x", "é-large", "x" * 5000})
    patterns = sorted({word("ab-1*?[]!", 6) for _ in range(150)} | {"", "*", "m" * 20 + "*x", "*" + "m" * 39 + "x", "é*", "*-large", "*x*", "a[b"})
    patterns = [p for p in patterns if "[!]" not in p and "[]" not in p and "-" not in p[1:-1]] + ["*-large"]  # sets are tested with the matcher
    got = C.glob_pairs(
        spark.createDataFrame([(v,) for v in values] + [(None,)], "value string"), spark.createDataFrame([(p,) for p in {*patterns, None}], "pattern string")
    )
    pairs = sorted((r.pattern, r.value) for r in got.collect())
    assert pairs == sorted((p, v) for p in set(patterns) for v in values if fnmatchcase(v, p))


def test_model_choice_without_offers_and_with_odd_lists(spark):
    providers = "provider string, models array<string>, default_model string"
    requests = spark.createDataFrame(
        [(1, None, None, None), (2, None, None, []), (3, None, None, [None, "m*", "m*"]), (4, "r", None, None), (5, None, None, ["*2"])],
        "packet_id int, requested string, recommended string, patterns array<string>",
    )
    choose = lambda rows: {r.packet_id: (r.model, r.provider) for r in C.choose_models(requests, spark.createDataFrame(rows, providers)).collect()}
    nobody = dict.fromkeys((1, 2, 3, 5), (None, None))
    assert choose([]) == nobody | {4: ("r", None)}
    assert choose([("p", None, ""), ("o", [None], None)]) == dict.fromkeys((1, 2, 3, 5), (None, "o")) | {4: ("r", "o")}
    offers = [("p", ["z", "m2", "m1", "m2"], "d"), ("q", ["m1", "a2"], None)]
    assert choose(offers) == {1: (None, "p"), 2: ("z", "p"), 3: ("m2", "p"), 4: ("r", "p"), 5: ("m2", "p")}


def test_drift(spark):
    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    actual = spark.createDataFrame([("a", "1"), ("b", "x"), ("extra", "9")], "path string, digest string")
    got = {r.path: r.problem for r in I.artifact_drift(expected, actual, ["path"]).collect()}
    assert got == {"b": "mismatch", "c": "missing"}
    same = spark.createDataFrame([(1, "v", None)], "k int, version string, profile string")
    other = spark.createDataFrame([(1, "v", "p")], "k int, version string, profile string")
    assert I.plan_drift(same, same, ["k"], ["version", "profile"]).count() == 0
    assert [(r.field, r.expected, r.got) for r in I.plan_drift(same, other, ["k"], ["version", "profile"]).collect()] == [("profile", "p", None)]


def test_tree_fingerprint_schemes(spark):
    import hashlib

    rows = [("t", p, f"d{p}") for p in ("a-b", "a/b", "c")] + [("u", "x", "1")]
    files = spark.createDataFrame(rows, "tree string, path string, digest string")
    got = {r.tree: r for r in I.tree_fingerprints(files).collect()}
    assert {r.scheme for r in got.values()} == {"bucketed"} and got["t"].n_files == 3
    flat = {r.tree: r for r in I.tree_fingerprints(files, scheme="flat").collect()}
    assert flat["u"].fingerprint == hashlib.sha256(b"x:1").hexdigest()
    assert flat["t"].fingerprint == hashlib.sha256(b"a/b:da/b\na-b:da-b\nc:dc").hexdigest()
    moved = files.withColumn("digest", F.when(F.col("path") == "c", F.lit("new")).otherwise(F.col("digest")))
    assert {r.tree: r for r in I.tree_fingerprints(moved).collect()}["t"].fingerprint != got["t"].fingerprint


def test_tags(spark):
    counts = spark.createDataFrame([(".ts", 2), (".tsx", 1), (".md", 1), (".json", 4), (".py", 0)], "ext string, files long")
    assert I.infer_tags(counts, "corpus").first().tags == ["corpus", "docs", "typescript"]


def test_numbers_of_any_length_order_by_value(spark):
    texts = ["1." + "9" * 38, "1.1" + "0" * 38, "1.0" + "9" * 45, "2.0", "1.00007", "1.8"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").orderBy(version_key(F.col("v"))).collect()
    assert [r.v for r in rows] == sorted(texts, key=lambda t: [int(x) for x in t.split(".")])


def test_pins_change_field_by_field(spark):
    pins = spark.createDataFrame([("a", "1", "2"), ("b", "1", None)], "name string, pinned string, active string")
    changes = spark.createDataFrame([("a", "3", None), ("c", None, "9")], "name string, pinned string, active string")
    assert {tuple(r) for r in C.set_pins(pins, changes).collect()} == {("a", "3", "2"), ("b", "1", None), ("c", None, "9")}


def test_models_of_many_providers(spark):
    providers = spark.createDataFrame(
        [(f"p{i:05d}", [f"m{i}", f"n{i}"], None) for i in range(12_000)] + [("a", [], "solo"), ("b", None, None)],
        "provider string, models array<string>, default_model string",
    )
    requests = spark.createDataFrame(
        [(1, "m7", None, []), (2, None, "unknown", []), (3, None, None, ["n11999", "zz*"]), (4, None, None, []), (5, None, None, ["none*"])],
        "packet_id int, requested string, recommended string, patterns array<string>",
    )
    got = {r.packet_id: (r.model, r.provider) for r in C.choose_models(requests, providers).collect()}
    assert got == {1: ("m7", "p00007"), 2: ("unknown", "a"), 3: ("n11999", "p11999"), 4: ("solo", "a"), 5: (None, "a")}


def test_publishing_and_use_through_stored_tables(spark, tmp_path):
    from chunkweave.sources import packets as P

    root = str(tmp_path)
    schema = "id long, name string, version string, size_bytes long"
    P.replace_table(spark.createDataFrame([(1, "a", "1.0", 5), (2, "a", "2.0", 5)], schema), root, "versions")
    new = spark.createDataFrame([(7, "a", "2.0", 9), (8, "a", "3.0", 0), (9, "b", "1.0", 4), (10, "b", "1.0", 6)], schema).withColumnRenamed("id", "upload_id")
    for overwrite, size in ((False, 5), (True, 9)):
        P.replace_table(C.published(P.read_table(spark, root, "versions"), new, overwrite), root, "versions")
        rows = {(r.name, r.version): r.size_bytes for r in P.read_table(spark, root, "versions").collect()}
        assert rows == {("a", "1.0"): 5, ("a", "2.0"): size, ("b", "1.0"): 4}
    pins = P.read_table(spark, root, "pins", "name string, pinned string, active string")
    specs = spark.createDataFrame([("a@1.0",), ("b",), ("c@1",), ("b@9",)], "spec string")
    P.replace_table(C.use(pins, specs, P.read_table(spark, root, "versions")), root, "pins")
    assert {tuple(r) for r in P.read_table(spark, root, "pins").collect()} == {("a", None, "1.0"), ("b", None, "1.0")}


def test_an_empty_first_upload_does_not_use_up_the_version(spark):
    current = spark.createDataFrame([("a", "1.0")], "name string, version string")
    rows = [(1, "a", "2.0", 0), (2, "a", "2.0", 5), (3, "a", "2.0", 7), (4, "a", "1.0", 3), (5, "b", "1.0", 0), (6, "c", "1.0", None)]
    found = C.publish(current, spark.createDataFrame(rows, "upload_id int, name string, version string, size_bytes int"))
    assert {r.upload_id: r.outcome for r in found.collect()} == {1: "empty", 2: "created", 3: "repeated", 4: "conflict", 5: "empty", 6: "created"}


def test_short_keys_sort_as_the_keys_do(spark):
    odd = ["", "a", "a\x00", "a\x00b", "a\x01", "a\x01\x01", "a\x02", "ab", "A-rc", "1..2", "1-rc1-x", "1-rc1-x.1", "1-x-beta-3", "-", "1-\x00", None]
    frame = spark.createDataFrame([(v,) for v in [*ASCENDING, *odd]], "v string").select(version_key(F.col("v")).alias("key"))
    pairs = frame.withColumn("text", sort_text(F.col("key")))
    other = pairs.selectExpr("key AS key2", "text AS text2")
    wrong = pairs.crossJoin(other).where("(key < key2) != (text < text2) OR (key = key2) != (text = text2)")
    assert wrong.count() == 0


def test_latest_versions_sort_short_rows(spark):
    latest = C.latest_versions(spark.createDataFrame([("a", "1.10"), ("a", "1.9")], "name string, version string"))
    assert latest.first().version == "1.10"
    shuffled = [line for line in latest._jdf.queryExecution().toString().splitlines() if "AS vkey" in line]
    assert shuffled and "concat(" in shuffled[0]  # text, not an array of structs


def test_a_version_of_many_packages_is_keyed_once(spark, monkeypatch):
    keyed, key_of = spark.sparkContext.accumulator(0), C.version_key

    @F.udf("string")
    def counted(version):
        keyed.add(1)
        return version

    monkeypatch.setattr(C, "version_key", lambda column: key_of(counted(column)))
    rows = spark.range(300).selectExpr("concat('p', id % 100) AS name", "element_at(array('1.10', '1.9', null), CAST(id DIV 100 + 1 AS INT)) AS version")
    latest = C.latest_versions(rows).collect()
    assert keyed.value == 3 and len(latest) == 100 and {r.version for r in latest} == {"1.10"}
    pins = spark.createDataFrame([("p1", "1.9", None)], "name string, pinned string, active string")
    left = rows.where("version IS NOT NULL").exceptAll(C.prune_plan(rows.where("version IS NOT NULL"), pins)).collect()
    assert keyed.value == 5 and sorted(r.version for r in left) == ["1.10"] * 100 + ["1.9"]


def test_publishing_without_overwriting_leaves_stored_rows_as_they_are(spark):
    stored = spark.createDataFrame([(1, "a", "1.0", 5), (2, None, None, 5)], "id bigint, name string, version string, size_bytes bigint")
    incoming = spark.createDataFrame(
        [(7, "a", "1.0", 6), (8, "a", "2.0", 6), (9, "a", "2.0", 7), (10, "b", "1.0", 0)], "upload_id bigint, name string, version string, size_bytes bigint"
    )
    after = C.published(stored, incoming)
    assert sorted(r.id for r in after.collect()) == [1, 2, 8]
    assert "LeftAnti" not in after._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in C.published(stored, incoming, overwrite=True).collect()) == [2, 7, 8]
