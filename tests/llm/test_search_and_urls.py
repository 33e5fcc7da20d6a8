from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkweave.llm.exact_topk import Shard, index_shard, top
from chunkweave.llm.queries import op2_exact_topk
from chunkweave.llm.url_filters import RULES, host_of, judge, match, mined_rules, path_of, tokens_of


@pytest.mark.parametrize("spread", [1, 40, 3000, 1 << 40])
def test_a_shard_returns_the_exact_best(spread):
    random_numbers = np.random.default_rng(spread % 1000)
    matrix = random_numbers.integers(-spread, spread + 1, (400, 12))
    matrix[50:80] = matrix[0]  # equal scores
    ids = random_numbers.permutation(400) * 3
    shard = Shard(index_shard(0, ids, matrix))
    for i in range(40):
        query, own = matrix[i], int(ids[i])
        exact = [int(sum(int(a) * int(b) for a, b in zip(row, query, strict=True))) for row in matrix]
        order = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), int(x)) for s, x in zip(exact, ids, strict=True) if x != own)[:10]
        found, scores = shard.best(query, own, 10)
        assert [(-int(s), int(x)) for s, x in zip(scores, found, strict=True)] == order


def test_the_search_stops_early_on_proof():
    matrix = np.random.default_rng(1).integers(-300, 300, (4000, 32))
    shard = Shard(index_shard(0, np.arange(4000), matrix))
    assert np.mean([len(shard.possible(matrix[i], i, 10)) for i in range(20)]) < 400


def test_top_orders_by_score_then_id():
    ids, scores = top(np.array([5, 3, 4, 1]), np.array([7, 7, -(1 << 63), 9]), 3)
    assert ids.tolist() == [1, 3, 5] and scores.tolist() == [9, 7, 7]


def test_queries_without_usable_vectors_have_no_rows(spark, edges):
    found = {r.query_id for r in op2_exact_topk(spark, edges).collect()}
    assert found == {0, 100, 200, 300, 600}


def by_list(url: str | None) -> tuple:
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut : min([rest.index(c, cut) for c in "?#" if c in rest[cut:]] or [len(rest)])]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_listed_urls(spark, edges):
    rows = judge(spark.read.parquet(f"{edges}/pages.parquet")).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{edges}/pages.parquet").collect()}
    for row in rows:
        host, path, rule, verdict = by_list(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if rule else row.verdict in ("allow", "block")
    by_id = {r.page_id: r for r in rows}
    assert by_id[17].verdict == "block" and by_id[17].mined_rule == "dir=es"  # learned from net/es/
    assert by_id[0].verdict == "allow" and by_id[0].confidence is None


def test_mined_rules_equal_brute_force(spark):
    random.seed(4)
    baskets = []
    for _ in range(300):
        tokens = sorted(random.sample(["a=1", "b=1", "c=1", "d=1"], random.randint(1, 3)))
        baskets.append((tokens, "block" if "a=1" in tokens and "b=1" in tokens or random.random() < 0.1 else "allow"))
    rules = mined_rules(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.05, 0.8)
    found = {(tuple(r.antecedent), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in rules.collect()}
    expected = {}
    names = ["a=1", "b=1", "c=1", "d=1"]
    for mask in range(1, 16):
        part = tuple(n for i, n in enumerate(names) if mask >> i & 1)
        holding = [v for t, v in baskets if set(part) <= set(t)]
        for verdict in ("allow", "block"):
            n = holding.count(verdict)
            if n / len(baskets) >= 0.05 and n / len(holding) >= 0.8:
                expected[part, verdict] = (round(n / len(holding), 9), round(n / len(baskets), 9))
    covered = {
        (part, verdict)
        for (part, verdict), (confidence, _) in expected.items()
        if any(expected.get((tuple(x for x in part if x != token), verdict), (-1, 0))[0] >= confidence for token in part)
    }
    assert expected and found == {k: v for k, v in expected.items() if k not in covered}
    assert found[("a=1", "b=1"), "block"][0] > 0.95
    sets = spark.createDataFrame([(list(t),) for t in {tuple(b[0]) for b in baskets}], "tokens array<string>")
    for row in match(sets, rules).collect():
        fitting = [(c, s, len(p), list(p), v) for (p, v), (c, s) in found.items() if set(p) <= set(row.tokens)]
        assert row.mined.verdict == max(fitting)[4]


def test_tokens_of_the_same_pages_are_one_item(spark):
    random.seed(9)
    groups = [["a=1", "a=2", "a=3"], ["b=1"], ["c=1", "c=2"]]
    baskets = []
    for _ in range(200):
        chosen = random.sample(groups, random.randint(1, 3))
        baskets.append((sorted(t for g in chosen for t in g), "block" if groups[0] in chosen and random.random() < 0.95 else "allow"))
    rules = mined_rules(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.05, 0.6).collect()
    assert {tuple(map(tuple, r.classes)) for r in rules} <= {tuple(map(tuple, c)) for c in ([groups[0]], [groups[1]], [groups[2]], groups[:2], groups[1:], groups[::2], groups)}
    assert {r.anchor for r in rules if r.antecedent == ["a=1"]} == set(groups[0])
    # Rules over single tokens by brute force: every combination, without those that a part makes needless.
    names, single = sorted(t for g in groups for t in g), {}
    for mask in range(1, 1 << len(names)):
        part = tuple(n for i, n in enumerate(names) if mask >> i & 1)
        holding = [v for t, v in baskets if set(part) <= set(t)]
        for verdict in ("allow", "block"):
            n = holding.count(verdict)
            if n / len(baskets) >= 0.05 and n / len(holding) >= 0.6:
                single[part, verdict] = (n / len(holding), n / len(baskets))
    kept = {
        (p, v): found
        for (p, v), found in single.items()
        if not any(single.get((tuple(x for x in p if x != token), v), (-1, 0))[0] >= found[0] for token in p)
    }
    frame = spark.createDataFrame([tuple(r) for r in rules], "antecedent array<string>, classes array<array<string>>, verdict string, confidence double, support double, anchor string")
    asked = [[n for i, n in enumerate(names) if mask >> i & 1] for mask in range(1, 1 << len(names))]
    decided = {tuple(r.tokens): r.mined for r in match(spark.createDataFrame([(t,) for t in asked], "tokens array<string>"), frame).collect()}
    for tokens in asked:
        fitting = [(c, s, len(p), list(p), v) for (p, v), (c, s) in kept.items() if set(p) <= set(tokens)]
        mine = decided.get(tuple(tokens))
        assert (mine is None) == (not fitting)
        if fitting:
            best = max(fitting)
            assert (mine.n, mine.antecedent, mine.verdict) == best[2:] and abs(mine.confidence - best[0]) < 1e-9


def test_many_tokens_in_common_are_no_burden(spark):
    deep = "/".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(i, f"http://x.net/es/{deep}/{i}") for i in range(20)] + [(100, f"http://y.org/{deep}/1"), (101, "http://y.org/q/ab/"), (102, "ftp://y.org/q/zz/")]
    found = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(found[i].verdict == "block" and found[i].rule == "net/es/" for i in range(20))
    # One token of the class is enough, and the last one a page holds is named.
    assert found[100].mined_rule == "subdir=bn" and found[101].mined_rule == "subdir=ab" and found[102].mined_rule is None


def test_one_url_on_most_rows_and_repeated_rows(spark):
    rows = [(i % 7, "http://y.org/q/ads/1") for i in range(300)] + [(1000 + i, f"http://x.net/es/q/ads/{i}") for i in range(50)] + [(None, None)] * 3
    found = judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(found) == 353 and {(r.verdict, r.mined_rule) for r in found if r.host == "y.org"} == {("block", "subdir=ads")}


def test_tokens_cover_the_whole_url(spark):
    urls = [
        ("http://a.b.c.x.org/d1/e/ads/deep/banner.jsonld?page=2&ref=x&" + "n" * 40 + "=1&ref=y#top", "label=a label=b subdir=e subdir=ads subdir=deep dir=d# stem=banner ext=jsonld param=page param=ref fragment=yes param=" + "n" * 40),
        ("http://x.org/a/b/ads/1", "dir=a subdir=b subdir=ads stem=#"),
        ("http://x.org/a/b/news/", "dir=a subdir=b subdir=news"),
        ("http://x.org/#a?b=1", "fragment=yes"),
    ]
    frame = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "i int, url string")
    url = F.col("url")
    found = {r.i: r.t for r in frame.select("i", tokens_of(url, host_of(url), path_of(url)).alias("t")).collect()}
    for i, (_, expected) in enumerate(urls):
        own = [t for t in found[i] if t.split("=")[0] in ("label", "dir", "subdir", "stem", "ext", "param", "fragment")]
        assert sorted(own) == sorted(expected.split()) and len(set(found[i])) == len(found[i])


def test_rules_tell_deep_directories_and_later_parameters_apart(spark):
    rows = [(i, f"http://x.net/es/q/ads/{i}") for i in range(20)] + [(50 + i, f"http://x.com/q/q/news/{i}?page=1&ref=x") for i in range(20)]
    rows += [(100, "http://y.org/a/b/ads/1"), (101, "http://y.org/a/b/news/1"), (102, "http://y.org/a?ref=1")]
    found = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (found[100].verdict, found[101].verdict) == ("block", "allow")
    assert found[100].mined_rule == "subdir=ads" and found[101].mined_rule == "subdir=news" and found[102].mined_rule == "param=ref"
