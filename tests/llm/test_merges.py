import json
import random

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import chunks

VOCABULARY = "word_bpe_49k.json"


class Counting:
    """The library, and the texts that were handed to it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode(self, text, **options):
        self.texts.append(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def words(n: int, seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzETAOINéÀßÿÖñ.,;:!?-_\"$%&*()[]{}|>/'#0189<÷×µªΣΑ日🎉́ﬁİ"
    return ["".join(rng.choices(letters[: rng.choice([6, 26, 32, 38, 50, len(letters)])], k=rng.randint(0, 60))) for _ in range(n)]


def test_latin_words_bypass_the_library():
    latin = [f"{x}{mark}" for x in ("the", "Étude", "straße", "xqzjv", "WORDS", "naïve") for mark in ("", ".", "...", ",%%%", "-un")]
    other = ["don't", "12", "日本語", "a<|endoftext|>", "ΟΔΟΣ", "x" * 600]
    ids = chunks.WordIds(VOCABULARY)
    want = [e.ids for e in ids.tokenizer.encode_batch_fast(latin + other, add_special_tokens=False)]
    ids.tokenizer = counting = Counting(ids.tokenizer)
    flat, offsets, *_ = ids(pa.array([" ".join(latin), *latin, *other]), None)
    got = [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [sum(want[: len(latin)], []), *want]
    handed = " ".join(counting.texts).split()
    assert sorted(handed) == sorted(other)


def test_merges_equal_the_library():
    ids = chunks.WordIds(VOCABULARY)
    some = ["", "a", "é", "!", "aaaaaaaa", "a" * 48, "a" * 49, "é" * 24, "é" * 25, "<|endoftext|>", "x<|startoftext|>", *words(5000)]
    want = [e.ids for e in ids.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    assert ids._encode(pa.array(some, pa.string())).to_pylist() == want
    assert ids._encode(some).to_pylist() == want
    known, _ = ids.merges(pa.array(some, pa.string()))
    assert 0.3 < np.mean(known) < 1
    assert len(ids._encode(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize(
    "change",
    [
        lambda spec: spec["normalizer"]["normalizers"].pop(),
        lambda spec: spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[\p{L}]+|[^\s\p{L}]+"),
        lambda spec: spec["added_tokens"].append({**spec["added_tokens"][0], "id": 49408, "content": "the"}),
        lambda spec: spec["model"].update(ignore_merges=True),
    ],
)
def test_files_with_other_rules_stay_with_the_library(tmp_path, change):
    with open(chunks.tokenizer_path(VOCABULARY), encoding="utf-8") as f:
        spec = json.load(f)
    change(spec)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    ids = chunks.WordIds(str(path))
    assert ids.merges is None
    some = ["the", "Other", "xthe.", "a1", *words(200)]
    assert ids._encode(some).to_pylist() == [ids.tokenizer.encode(x, add_special_tokens=False).ids for x in some]
