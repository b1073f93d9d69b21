import math

import numpy as np
import pytest

from emberlog.llm import metric_search


def brute(rows, k):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in sorted(sound, reverse=True) if i % 100 == 0}.items():
        hits = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(hits, 1)]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as dim", "2 as shard", "3 as score").repartition(3)
    return sorted(tuple(r) for r in metric_search.nearest(frame, **options).collect())


def vectors(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.1 * x
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]


@pytest.mark.parametrize(("n", "dim", "clusters"), [(900, 8, 0), (1500, 4, 6), (301, 1, 0), (5, 3, 0), (101, 64, 2)])
def test_equals_brute_force(spark, monkeypatch, n, dim, clusters):
    monkeypatch.setattr(metric_search, "SHARD", 400)
    monkeypatch.setattr(metric_search, "QUERIES", 4)
    rows = vectors(n, dim, n, clusters)
    assert run(spark, rows) == brute(rows, 10)


def test_odd_rows_and_ties(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [float("nan"), 1.0]), (300, [None, 1.0]), (400, [float("inf"), 1.0]), (500, []), (None, [1.0, 1.0]), (600, [1.0, 2.0, 3.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5])]
    rows += [(k, [1.0, 2.0]) for k in range(601, 800)]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, rows, k=3) == brute(rows, 3)
    assert metric_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_a_large_group_of_equal_vectors_is_split_over_shards(spark, monkeypatch):
    monkeypatch.setattr(metric_search, "SHARD", 50)
    monkeypatch.setattr(metric_search, "QUERIES", 3)
    rows = vectors(600, 5, 2, 9)
    rows += [(k, rows[10][1]) for k in range(600, 1100)] + [(k, [0.0] * 5) for k in range(1100, 1180)] + [(1180, [1.0]), (1200, [2.0])]
    assert run(spark, rows) == brute(rows, 10)


def test_queries_visit_only_cells_that_can_hold_a_hit(spark, monkeypatch):
    monkeypatch.setattr(metric_search, "SHARD", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 20
    rows = [(k, [float(np.float32(c)) for c in centres[k % 12] + 0.05 * rng.normal(size=16)]) for k in range(2400)]
    sent = []
    visit = metric_search._visit
    monkeypatch.setattr(metric_search, "_visit", lambda pages, pairs, k: (sent.append(pairs.count()), visit(pages, pairs, k))[1])
    assert run(spark, rows) == brute(rows, 10)
    assert sent[0] == 24 and sent[1] < 24 * 24 / 2  # of 24 queries and as many shards


def test_pages_are_pruned():
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(40, 6))[rng.integers(0, 40, 6000)] * 1000 + rng.normal(size=(6000, 6)) * 5).astype(np.int64)
    pages = metric_search.build(np.arange(6000), data)
    seen = []

    class Counted(list):
        def __getitem__(self, k):
            seen.append(k)
            return super().__getitem__(k)

    hits = metric_search.search(Counted(pages), -1, data[17], 10)
    scores = data @ data[17]
    assert [s for s, _ in hits] == sorted(scores.tolist(), reverse=True)[:10]
    assert len(seen) < len(pages) / 3
