"""Hyperdimensional profiles against a plain version that binds, bundles and compares one n-gram at a time."""

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import language_id
from emberlog.llm.words import mix

DIM = language_id.DIMENSIONS


def letter_vector(letter):
    """A letter's random signs; the gap between words has a vector of its own."""
    point = 0 if letter is None else ord(letter)
    bits = "".join(f"{byte:08b}" for seed in mix(np.arange(DIM // 64, dtype=np.uint64) + np.uint64((point + 1) * 4096)).tolist() for byte in seed.to_bytes(8, "little"))
    return [1 if b == "1" else -1 for b in bits]


def grams_of(text):
    """Trigrams over letters in lower case; each run of other characters, and either end, is one gap."""
    out = [None]
    for c in text or "":
        if unicodedata.category(c).startswith("L"):
            low = c.lower()
            out.append(low if len(low) == 1 else c)
        elif out[-1] is not None:
            out.append(None)
    if out[-1] is not None:
        out.append(None)
    if len(out) < 3 or not any(out):
        return Counter()
    return Counter(tuple(out[k : k + 3]) for k in range(len(out) - 2))


def rotated(vector, by):
    return vector[-by:] + vector[:-by] if by else vector


def plain_vector(text):
    total = [0] * DIM
    for gram, n in grams_of(text).items():
        parts = [rotated(letter_vector(c), 2 - place) for place, c in enumerate(gram)]
        for d in range(DIM):
            total[d] += n * parts[0][d] * parts[1][d] * parts[2][d]
    norm = math.sqrt(sum(x * x for x in total))
    return [x / norm for x in total] if norm else total


def plain_language_id(rows):
    """doc -> (held_out, lang, score)"""
    sums = {}
    for doc, text, lang in rows:
        if lang is not None and text is not None and not (doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2):
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * DIM), plain_vector(text))]
    table = {}
    for lang, v in sums.items():
        norm = math.sqrt(sum(x * x for x in v))
        table[lang] = [x / norm if norm else 0 for x in v]
    out = {}
    for doc, text, _ in rows:
        held = doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2
        v = plain_vector(text)
        if not any(v) or not table:
            out[doc] = (held, "und", 0.0)
            continue
        found = {lang: sum(a * b for a, b in zip(v, p)) for lang, p in table.items()}
        best = max(sorted(found), key=lambda x: found[x])
        out[doc] = (held, best, min(1.0, max(0.0, found[best])))
    return out


def some_texts():
    rng = random.Random(11)
    words = {"en": "the of and that harbour which morning very", "fr": "le des une était où garçon chez très", "de": "der und straße über nicht auch wir früh"}
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(1, 30))).capitalize() + rng.choice([".", " 12!", ""]), lang) for k, lang in enumerate(rng.choices(list(words), k=60))]
    return rows + [(60, None, "en"), (61, "", "fr"), (62, "123 -- 4", "de"), (63, "Ω Ж 漢", None), (64, "İSTANBUL ǅ", None), (65, "a", None), (None, "le garçon", "fr"), (67, rows[0][1], None)]


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred", "2 as key", "3 as vector").repartition(4)
    return {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in language_id.language_id(frame, **more).collect()}


def test_equals_the_plain_version(spark):
    rows = some_texts()
    got, want = run(spark, rows), plain_language_id(rows)
    assert set(got) == set(want)
    for doc in want:
        assert got[doc][:2] == want[doc][:2] and got[doc][2] == pytest.approx(want[doc][2], abs=1e-4), doc


def test_repeated_rows_and_ties(spark):
    frame = spark.createDataFrame([(4, "the same words", "b"), (4, "the same words", "b"), (6, "the same words", "a"), (7, "the same words", None)], "doc_id long, text string, lang string")
    found = [tuple(r) for r in language_id.language_id(frame).orderBy("doc_id").collect()]
    assert [r[0] for r in found] == [4, 4, 6, 7] and {r[2] for r in found} == {"a"}  # equal prototypes: the smaller name


def test_very_long_texts_and_no_rows(spark):
    long = "und der wir " * 150_000
    rows = [(1, "the of and that", "en"), (3, "der und wir nicht", "de"), (4, long, None), (8, long.replace(" ", ""), None)]
    got = run(spark, rows)
    assert got[4][1] == got[8][1] == "de" and got[4][2] > 0.5
    assert run(spark, rows, max_training=1)[4][1] == "de"
    assert language_id.language_id(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert language_id.prototypes(spark.createDataFrame([], "doc_id long, text string, lang string"))[0] == []
