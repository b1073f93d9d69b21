import random

import numpy as np
import pytest

from emberlog.llm import substring_dedup
from tests.llm import brute


def passages(seed, vocabulary=40, docs=60):
    """Texts that share passages, runs of one word, and copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    shared = [[rng.choice(words) for _ in range(rng.randint(3, 60))] for _ in range(8)]
    texts = {}
    for d in range(docs):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                parts += rng.choice(shared)
            elif kind < 0.65:
                parts += [rng.choice(words[:3])] * rng.randint(1, 50)
            else:
                parts += [rng.choice(words) for _ in range(rng.randint(1, 40))]
        texts[d] = rng.choice([" ", "\n", "  "]).join(parts)
    texts[docs], texts[docs + 1], texts[docs + 2] = texts[0], None, ""
    texts[docs + 3] = " ".join(words * 400)
    return texts


def run(spark, texts, window):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removed_words(frame, window).collect()}


@pytest.mark.parametrize(("seed", "window", "vocabulary"), [(0, 35, 40), (1, 8, 12), (2, 5, 3), (3, 12, 2), (4, 20, 500), (5, 1, 60)])
def test_equals_brute_force(spark, seed, window, vocabulary):
    texts = passages(seed, vocabulary)
    assert run(spark, texts, window) == brute.substring(texts, window)


def test_equal_windows_have_equal_representatives():
    rng = np.random.default_rng(0)
    for trial in range(30):
        words = rng.integers(0, rng.integers(2, 30), 400).astype(np.uint64)
        words[100:180] = words[250:330]
        words[20:60] = 7
        found = substring_dedup.levels(words * np.uint64(0x9E3779B97F4A7C15), np.repeat([0, 1], [200, 200]))
        for x in found:
            assert (np.diff(x.low) >= 0).all() and (np.diff(x.high) >= 0).all()
        size = int(rng.integers(3, 40))
        starts = substring_dedup._starts(np.array([0, 200, 400]), size)
        key, place = substring_dedup.representatives(found, starts, size)
        first = {}
        for s, k in zip(starts.tolist(), key.tolist()):
            assert first.setdefault(words[s : s + size].tobytes(), k) == k


def test_texts_and_odd_rows(spark):
    text = " ".join(f"x{k}" for k in range(50))
    odd = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, None, 2), (2, "only here", 3)], "doc_id long, text string, at int")
    rows = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.deduplicated(odd).collect())
    assert rows == [(0, 0, 0, ""), (1, 50, 50, ""), (1, 50, 50, ""), (2, 2, 0, "only here")]
    assert substring_dedup.removed_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_that_an_algebraic_hash_confuses(spark):
    """The word of 2 ** 10 letters whose letters count the bits of their place, and its complement, agree in any polynomial of an odd base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << 10))
    other = one.translate(str.maketrans("ab", "ba"))
    rest = [f"x{k}" for k in range(34)]
    texts = {0: " ".join([one, *rest]), 1: " ".join([other, *rest]), 2: " ".join([*rest, "y"]), 3: " ".join(["z", *rest, "y"])}
    assert run(spark, texts, 35) == brute.substring(texts, 35)
    assert [run(spark, texts, 35)[d][1] for d in range(4)] == [0, 0, 35, 35]
