import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import components, frames, ngram_join
from tests.llm import brute


def texts_of(seed, docs=120, vocabulary=300):
    rng = random.Random(seed)
    words = [rng.choice(["w", "W", "É"]) + str(k) for k in range(vocabulary)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 5, 9, 20, 60, 200]))] for _ in range(10)]
    texts = {}
    for d in range(docs):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            kind, at = rng.random(), rng.randrange(len(w))
            if kind < 0.5:
                w[at] = rng.choice(words)
            elif kind < 0.75 and len(w) > 1:
                del w[at]
            else:
                w.insert(at, rng.choice(words))
        if rng.random() < 0.2:
            w += rng.choice(base)
        texts[d] = " ".join(w)
    texts[docs], texts[docs + 1], texts[docs + 2], texts[docs + 3] = None, "", " \n ", texts[0].swapcase()
    texts[docs + 4] = "a b c"
    texts[docs + 5] = "A  b\tc"
    return texts


def run(spark, texts, **options):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_components(frame, **options).collect()}


@pytest.mark.parametrize(("seed", "gram", "percent"), [(0, 4, 85), (1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_equals_brute_force(spark, seed, gram, percent):
    texts = texts_of(seed)
    want = brute.components(texts, gram, percent)
    assert len({c for _, c in want.values()}) < len(texts) - 20
    assert run(spark, texts, gram=gram, percent=percent) == want


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = texts_of(5, docs=80)
    assert run(spark, texts) == brute.components(texts)


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_enough_segments(percent):
    rng = np.random.default_rng(percent)
    levels = ngram_join.Levels(percent)
    linked = 0
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, 1 + n // 5))], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        linked += 1
        key, doc, kind, need = ngram_join.segment_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), levels)
        good = False
        for k in set(kind.tolist()):
            x, y = key[(doc == 0) & (kind == k)], key[(doc == 1) & (kind == k)]
            if len(x) and len(y):
                good |= len(np.intersect1d(x, y)) >= max(need[(doc == 0) & (kind == k)][0], need[(doc == 1) & (kind == k)][0])
        assert good
    assert linked > 40


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64) << np.uint64(58)) for _ in range(7)]
    parts = 4
    fragments = [x for s in sets for x in np.split(s, np.searchsorted(s, (np.arange(1, parts) << 62).astype(np.uint64)))]
    lane = np.concatenate(sets)
    got = ngram_join.overlaps([lane, lane + np.uint64(1)], np.concatenate([[0], np.cumsum([len(f) for f in fragments])]), parts)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(7) for j in range(7) if i != j)
    alike = ngram_join.overlaps([np.zeros(2, np.uint64), np.arange(2, dtype=np.uint64)], np.array([0, 1, 2]), 1)
    assert alike[0, 1] == 0  # one lane alone doesn't make shingles equal
    hashes, bounds = ngram_join.shingle_sets(pa.array(["a b c d e", "", "A B"]), 4)
    assert np.diff(bounds).tolist() == [2, 0, 1]


def test_words_that_an_algebraic_hash_confuses(spark):
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << 10))
    texts = {0: one + " x y z", 1: one.translate(str.maketrans("ab", "ba")) + " x y z", 2: one.upper() + "\tx y z"}
    assert run(spark, texts) == brute.components(texts) == {0: (1, 0), 1: (1, 1), 2: (1, 0)}


def test_a_cluster_around_a_text_and_chains_away_from_it(spark, monkeypatch):
    """Copies at growing distances from one text: some link with it, some only with each other, some with one that links with it."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for d in range(150):
        w = list(base)
        for k in range(rng.randint(0, 8)):
            w[rng.randrange(150)] = f"new{rng.randint(0, 30)}"
        texts[d] = " ".join(w)
    chain = list(base)
    for d in range(150, 190):
        chain[(d * 4) % 150] = f"step{d}"
        texts[d] = " ".join(chain)
    texts[190] = " ".join(f"long{k % 9000}" for k in range(60_000))
    texts[191] = texts[190] + " end"
    want = brute.components(texts)
    assert 3 < len({c for _, c in want.values()}) < 100
    assert run(spark, texts) == want


def test_blocks_of_a_large_cluster_meet_alike_sizes_in_rounds(spark, monkeypatch):
    """One cluster of texts that share a passage and have many sizes: a set goes to few blocks, and the blocks come in several rounds."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "ROUND_SHINGLES", 1)
    rng = random.Random(4)
    base, texts = [f"w{k}" for k in range(400)], {}
    for d in range(160):
        w = base[: int(30 * 1.02 ** rng.randint(0, 130))]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 50)}"
        texts[d] = " ".join(w)
    tables, staged = {}, frames.staged

    def watched(df, name):
        out = staged(df, name)
        tables.setdefault(name, []).append([r.asDict() for r in out.drop("first", "second").collect()] if name == "carried" else len(tables))
        return out

    monkeypatch.setattr(frames, "staged", watched)
    assert run(spark, texts) == brute.components(texts)
    (carried,) = tables["carried"]
    large = [r for r in carried if r["band"] > 0]
    assert len(large) > 50 and len(tables["round"]) > 1
    assert sum(r["copies"] for r in large) < len(large) ** 2 / 5 / 2  # to all blocks it would be twice as much at least


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 100}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = rng.sample(range(-500, 500), 200)
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(130)]
    parent = {}
    for a, b in edges:
        find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])  # noqa: B023, E731
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_tables_and_shuffle_files_go_when_they_are_used(spark):
    """What is on disk at a time doesn't add up over the steps of a join: neither its tables nor the shuffle files behind them."""
    root = Path(frames.shared_dir(spark).removeprefix("file:")) / f"emberlog-{spark.sparkContext.applicationId}"
    tables = lambda: {p.name for p in root.glob("*")}
    local = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffled = lambda: {str(x) for d in local for x in Path(d).rglob("shuffle_*")}
    texts = texts_of(11)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    freed, held, before = spark.conf.get(frames._FREED, None), shuffled(), tables()
    found = ngram_join.near_components(frame)
    assert {name.rsplit("-", 1)[0] for name in tables() - before} == {"found"}
    deadline = time.time() + 20
    while shuffled() - held and time.time() < deadline:  # files go in the background
        time.sleep(0.2)
    assert not shuffled() - held
    assert spark.conf.get(frames._FREED, None) == freed
    want = brute.components(texts)
    assert [{r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} for _ in range(2)] == [want, want]


def test_odd_rows(spark):
    text = "one two three four five six"
    odd = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, None, 2), (2, "x", 3)], "doc_id long, text string, cluster int")
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in ngram_join.near_components(odd).collect()) == [(0, 0), (1, 3), (1, 3), (2, 1)]
    assert ngram_join.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
