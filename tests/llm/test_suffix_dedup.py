import random

import pytest

from emberlog.llm import suffix_dedup
from emberlog.llm.suffixes import suffix_array
from tests.llm import brute


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    rng = random.Random(seed)
    for _ in range(300):
        s = [rng.randint(1, rng.randint(1, 6)) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    s = [1, 2, 1] * 200 + [0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def texts_of(seed, alphabet="abcdé \n\x00", docs=40):
    rng = random.Random(seed)
    shared = ["".join(rng.choices(alphabet, k=rng.randint(20, 300))) for _ in range(8)]
    texts = {}
    for d in range(docs):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind, s = rng.random(), rng.choice(shared)
            if kind < 0.4:
                parts.append(s)
            elif kind < 0.6:
                a = rng.randint(0, len(s) - 1)
                parts.append(s[a : a + rng.randint(1, 200)])
            elif kind < 0.7:
                parts.append(rng.choice("ab") * rng.randint(1, 300))
            else:
                parts.append("".join(rng.choices(alphabet, k=rng.randint(1, 100))))
        texts[d * 3] = "".join(parts)
    texts[1], texts[200], texts[201], texts[202] = texts[3], None, "", texts[0]
    texts[203] = "abcd " * 3000
    return texts


def run(spark, texts, length):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed_bytes(frame, length).collect()}


@pytest.mark.parametrize(("seed", "length", "alphabet"), [(0, 100, "abcdé \n\x00"), (1, 100, "ab"), (2, 70, "xyz\x00"), (3, 100, "abcdefghijklmnop"), (4, 130, "aé")])
def test_equals_brute_force(spark, seed, length, alphabet):
    texts = texts_of(seed, alphabet)
    assert run(spark, texts, length) == brute.suffixes(texts, length)


def test_small_buffers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED", 7)
    monkeypatch.setattr(suffix_dedup, "GATHERED", 5)
    texts = texts_of(9)
    assert run(spark, texts, 100) == brute.suffixes(texts, 100)


def test_bodies_and_odd_rows(spark):
    text = "".join(map(str, range(100, 200)))
    odd = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, None, 2), (2, "short", 3)], "doc_id long, text string, at int")
    rows = sorted((r["doc_id"] or 0, r["n_removed"], bytes(r["body"]).decode()) for r in suffix_dedup.deduplicated(odd).collect())
    assert rows == [(0, 0, ""), (1, 0, text), (1, 300, ""), (2, 0, "short")]
    assert suffix_dedup.removed_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
