"""Drift through stored fingerprint trees against the comparison of all files."""

from __future__ import annotations

import hashlib
import random

import pytest

from chunkweave.operators.integrity import artifact_drift
from chunkweave.operators.merkle import tree_drift, tree_nodes, write_tree

SCHEMA = "tree string, path string, digest string"


def files(n: int = 1200) -> list[tuple]:
    rng = random.Random(3)
    return [(f"t{i % 20}", f"dir{i % 7}/file{i}.txt", f"{rng.getrandbits(64):016x}") for i in range(n)]


def compared(spark, tmp_path, before, after):
    for name, rows in (("before", before), ("after", after)):
        write_tree(spark.createDataFrame(rows, SCHEMA), str(tmp_path / name))
    return tree_drift(spark, str(tmp_path / "before"), str(tmp_path / "after"))


def test_one_changed_file_reads_one_branch(spark, tmp_path):
    before = files()
    after = [(t, p, "changed" if p.endswith("/file777.txt") else d) for t, p, d in before]
    compared(spark, tmp_path, before, after)
    digit = hashlib.sha256(b"dir0/file777.txt").hexdigest()[0]
    others = [f for f in tmp_path.rglob("*.parquet") if "/files/" in str(f) and f"branch=h{digit}" not in str(f)]
    others += [f for f in tmp_path.rglob("*.parquet") if "depth=2" in str(f) and f"head=h{digit}" not in str(f)]
    assert len(others) > 40
    for path in others:  # whoever reads these fails
        path.write_bytes(b"unreadable")
    found = tree_drift(spark, str(tmp_path / "before"), str(tmp_path / "after"))
    assert [(r.tree, r.path, r.problem) for r in found.collect()] == [("t17", "dir0/file777.txt", "mismatch")]


def test_drift_equals_comparing_everything(spark, tmp_path):
    rng = random.Random(5)
    before = [*files(), (None, "a", "b"), ("t1", None, "b"), ("t1", "no digest", None)]
    after = [(t, p, rng.choice([d, d, d, "x"])) for t, p, d in before if rng.random() < 0.9 and t != "t3"]
    after += [("t99", "only/here", "d"), ("t5", "new/file", "d")]
    found = {tuple(r) for r in compared(spark, tmp_path, before, after).collect()}
    plain = artifact_drift(*[spark.createDataFrame([(t, p, d or "") for t, p, d in rows if t and p], SCHEMA) for rows in (before, after)], ["tree", "path"])
    assert found == {tuple(r) for r in plain.collect()} and len(found) > 100


@pytest.mark.parametrize("rows", [files(50), []])
def test_equal_and_empty_trees(spark, tmp_path, rows):
    assert compared(spark, tmp_path, rows, list(reversed(rows))).collect() == []


def test_nodes_add_up_and_see_every_change(spark):
    rows = files(300)

    def nodes(rows):
        return {(r.tree, r.prefix): (r.n_files, r.digest) for r in tree_nodes(spark.createDataFrame(rows, SCHEMA)).collect()}

    found = nodes(rows)
    for tree in {t for t, _, _ in rows}:
        own = {p: v for (t, p), v in found.items() if t == tree}
        assert own[""][0] == sum(1 for t, _, _ in rows if t == tree)
        for prefix in own:
            if len(prefix) < 3:
                assert own[prefix][0] == sum(n for p, (n, _) in own.items() if len(p) == len(prefix) + 1 and p.startswith(prefix))
    changed = nodes([*rows[:-1], (*rows[-1][:2], "other")])
    assert {key for key in found if found[key] != changed[key]} == {(rows[-1][0], p) for p in ["", *next(([k[1][:1], k[1][:2], k[1]] for k in found if k[0] == rows[-1][0] and len(k[1]) == 3 and found[k] != changed[k]))]}
    assert nodes([(t, f"{p}x", d) for t, p, d in rows])[("t0", "")] != found[("t0", "")]
