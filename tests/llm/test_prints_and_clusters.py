"""SimHash balls, zone-map clusters and importance resampling against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from chunkweave.llm import ball_hashing, target_resampling, zone_clusters
from tests.llm.conftest import DOCUMENTS, EXTRA_VALUES, edge_documents, prose

# ---------------------------------------------------------------- op11


def plain_print(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints: list[int], radius: int) -> dict[int, int]:
    """Least fingerprint that links lead to, by all pairs."""
    kinds = sorted(set(prints))
    root = {p: p for p in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in kinds}


def near_documents() -> list[tuple]:
    """Copies, near copies whose fingerprints differ in a few bits, and unrelated texts."""
    rows, rng, base = [], random.Random(11), prose(600, 5).split()
    for i in range(60):
        words = list(base)
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(words), "en", "s", 1, *EXTRA_VALUES))
    rows += [(2000 + i, prose(40, 100 + i), "en", "s", 1, *EXTRA_VALUES) for i in range(40)]
    return [*edge_documents(), *rows, rows[0], (None, *rows[1][1:]), (None, "only here without an id", None, None, None, *EXTRA_VALUES)]


def test_prints_and_components_equal_all_pairs(spark):
    rows = near_documents()
    prints = [plain_print(r[1]) for r in rows]
    roots = plain_roots(prints, 4)
    ids: dict = {}
    for row, own in zip(rows, prints, strict=True):
        if row[0] is not None:
            ids[roots[own]] = min(row[0], ids.get(roots[own], row[0]))
    expected = Counter((r[0], f"{p:016x}", ids.get(roots[p])) for r, p in zip(rows, prints, strict=True))
    found = ball_hashing.near_duplicates(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    linked = Counter(roots.values())
    assert max(linked.values()) > 5  # different fingerprints were linked


def scattered(seed: int, n: int) -> list[int]:
    """Random fingerprints, with balls and chains of near ones around some, many below one leading part."""
    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(n)}
    for centre in list(found)[: n // 20]:
        at = centre
        for _ in range(20):
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                at ^= 1 << bit
            found.add(at)
            if rng.random() < 0.5:
                at = centre
    found |= {(0xAB << 56) | rng.getrandbits(20) for _ in range(n // 4)}
    return sorted(found)


@pytest.mark.parametrize(("radius", "most"), [(4, None), (4, 20_000), (2, 300)])
def test_no_link_is_missed(spark, monkeypatch, radius, most):
    if most:  # heads with more variants are dealt again on more bits
        monkeypatch.setattr(ball_hashing, "MOST_VARIANTS", most)
    prints = scattered(radius, 400)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in ball_hashing.connections(frame, radius).collect()]
    expected = plain_roots(prints, radius)
    assert all(expected[a] == expected[b] for a, b in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {p: find(p) for p in prints} == expected


def test_dealt_heads_hold_all_variants():
    prints = np.array(scattered(3, 40), dtype=np.uint64)
    dealt = list(ball_hashing.deal(0, np.zeros(len(prints), dtype=np.uint64), prints, 8, 2))
    assert sum(n for *_, n in dealt) == len(prints) * ball_hashing.ball_size(64, 2) == len(prints) * 2081
    again = [
        row
        for level, head, packed, _ in dealt
        for own in [np.frombuffer(packed, dtype=np.uint64)]
        for row in ball_hashing.deal(level, np.full(len(own), head, dtype=np.int64).view(np.uint64), own, 8, 2)
    ]
    assert sum(n for *_, n in again) == len(prints) * 2081


def test_pieces_do_not_change_a_print(monkeypatch):
    text = (prose(3000, 4) + " \t\n ").upper() + "é" * 50 + " end"
    expected = plain_print(text)
    for piece in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(ball_hashing, "PIECE", piece)
        assert ball_hashing.fingerprint(text.encode()) == expected
    assert ball_hashing.fingerprint(b"") == 0 == plain_print(" \n")


def test_only_even_radii(spark):
    with pytest.raises(ValueError, match="even"):
        ball_hashing.connections(spark.createDataFrame([(1,)], "print long"), 3)


# ---------------------------------------------------------------- op12


def plain_clusters(rows: list[tuple], clusters: int, rounds: int, scale: float = 256.0) -> list[tuple]:
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [min(max(math.floor(scale * float(np.float32(x))), -(1 << 63)), (1 << 63) - 1) for x in vector]))
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:clusters]]

    def assign():
        found = []
        for _, v in kept:
            distances = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centres]
            found.append((distances.index(min(distances)), min(distances)))
        return found

    for _ in range(rounds):
        own = assign()
        for k in range(len(centres)):
            members = [v for (_, v), (c, _) in zip(kept, own, strict=True) if c == k]
            if members:
                centres[k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    own = [(c, min(d, (1 << 63) - 1)) for c, d in assign()]
    inertia = Counter()
    for c, d in own:
        inertia[c] += d
    top = (1 << 63) - 1
    return [
        (i, c, d, min(inertia[c], top), min(sum(inertia.values()), top), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for (i, _), (c, d) in zip(kept, own, strict=True)
    ]


def blobs(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    return [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 12]]) for i in range(n)]


def clustered(spark, rows, **options):
    frame = spark.createDataFrame([(*r, *EXTRA_VALUES) for r in rows], "vec_id long, embedding array<float>, " + DOCUMENTS.split("n_chars long, ")[1])
    found = zone_clusters.cluster_vectors(frame, **options)
    return Counter(tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_equal_loops_on_hostile_vectors(spark):
    rows = blobs(200, 1)
    rows += rows[:30] + [(None, rows[3][1])] * 3 + [(5, rows[9][1])]  # repeated, without an id, one id twice
    rows += [(300 + i, [1.0] * 64) for i in range(60)]  # a hot vector
    rows += [(400, None), (401, [1.0] * 63), (402, [1.0] * 63 + [None]), (403, [float("nan")] * 64), (404, [float("inf")] * 64), (405, [])]
    assert clustered(spark, rows) == Counter(plain_clusters(rows, 40, 5))


@pytest.mark.parametrize("size", [1e5, 1e7, 1e16, 5e37])
def test_large_components_stay_exact(spark, size):
    rows = blobs(40, 2) + [(100 + i, [size * x for x in v]) for i, v in blobs(20, 3)]
    assert clustered(spark, rows, clusters=7, rounds=3) == Counter(plain_clusters(rows, 7, 3))


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = blobs(3, 4)
    assert clustered(spark, rows) == Counter(plain_clusters(rows, 40, 5))
    assert clustered(spark, [(1, None)]) == Counter() == clustered(spark, [(None, rows[0][1])])


def test_hilbert_keys_walk_from_cell_to_neighbour():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = [k.tobytes() for k in zone_clusters.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_map_leaves_few_candidates(spark):
    rows = [(i, [float(x) for x in v]) for i, v in blobs(12_000, 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    integers = zone_clusters.integer_vectors(frame)
    blocks = zone_clusters.build_blocks(integers)
    centroids = zone_clusters.starting_centroids(integers, 40, 2)
    found = zone_clusters.zone_map(blocks, centroids).collect()
    assert sum(r.size for r in found) == len(rows) and max(r.size for r in found) <= zone_clusters.BLOCK_ROWS
    assert sum(r.size * r.candidates for r in found) < 0.5 * 40 * len(rows)  # most comparisons are spared


# ---------------------------------------------------------------- op13


def plain_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_features(text: str | None, longest: int, buckets: int) -> list[int]:
    words = plain_words(text)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(rows, targets, longest=1, buckets=10_000, least=20, percent=10):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(plain_features(text, longest, buckets))
    for text in targets:
        t.update(plain_features(text, longest, buckets))
    total_s, total_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in range(buckets)]
    found = []
    for doc_id, text in rows:
        features = plain_features(text, longest, buckets)
        weight, score = sum(gain[b] for b in features), None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([doc_id, len(features), weight, score, None, len(plain_words(text)) >= least and doc_id is not None])
    eligible = sorted((r for r in found if r[5]), key=lambda r: (-r[3], r[0], r[1]))
    for rank, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in found)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 60), (2, 100)])
def test_resampling_equals_loops(spark, longest, percent):
    rows = [(r[0], r[1]) for r in near_documents()] + [(3000 + i, prose(25 + i % 9, i)) for i in range(300)]
    rows += [(None, prose(30, 1)), rows[20], rows[20]] + [(77, prose(40, 2))] * 100  # a hot group of equal rows
    targets = [prose(50, i) for i in range(5)] + [None, ""]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, rank int, segment int, place string").repartition(5)
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, bucket int")
    found = target_resampling.resample(docs, target, percent, max_run=longest).collect()
    assert Counter(tuple(r) for r in found) == plain_resample(rows, targets, longest, percent=percent)


def test_runs_samples_and_segments(spark, monkeypatch):
    random.seed(4)
    rows = [(i, 30, 0, random.choice([5, 5, random.randrange(1000)])) for i in range(3000)]  # a third and more of equal scores
    frame = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(6)
    runs = target_resampling.sorted_runs(frame)
    cuts = target_resampling.splitters(runs, len(rows), samples=300, segments=30)
    sizes = [r["count"] for r in target_resampling.with_segment(runs, cuts).groupBy("segment").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 10 * (len(cuts) // 30 + 10) + 10 * 8  # the bound of regular sampling
    expected = sorted(rows, key=lambda r: (-r[3], r[0]))
    found = target_resampling.ranked(frame, 50).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in found] == [(i, r[0]) for i, r in enumerate(expected[:1500], 1)]


def test_empty_target(spark):
    docs = spark.createDataFrame([(1, prose(30, 1)), (2, None)], "doc_id long, text string")
    found = target_resampling.resample(docs, docs.filter("false"), 50).collect()
    assert Counter(tuple(r) for r in found) == plain_resample([(1, prose(30, 1)), (2, None)], [], percent=50)


def test_word_pieces_keep_runs_together(monkeypatch):
    text = (prose(300, 8) + " Ünï Straße x1y2 日本語,語 ") * 3
    for piece in (1, 9, 64, 1 << 20):
        monkeypatch.setattr(target_resampling, "PIECE", piece)
        found = Counter()
        for _, buckets in target_resampling.feature_pieces(text.encode(), 3, target_resampling.Buckets(500)):
            found.update(buckets.tolist())
        assert found == Counter(plain_features(text, 3, 500))


def test_the_largest_head_of_a_task_takes_bounded_memory():
    """Near copies fill a head up to the most variants that a task takes."""
    import tracemalloc

    n = ball_hashing.MOST_VARIANTS // ball_hashing.ball_size(56, 2)
    prints = np.unique(np.uint64(7 << 56) ^ ball_hashing.ball(40, 3)[:n])
    ball_hashing.ball(56, 2)
    tracemalloc.start()
    met, least = ball_hashing.collisions(8, 7, prints, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(met) == n - 1 and (least == prints[0]).all()
    assert peak < 100 << 20
