import hashlib
import random

import pytest

from emberlog.llm import chunks, sentence_pieces

TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "  two  spaces   three\n\nlines \t tabs\r\n end ", "▁", "a▁b ▁ c", "<s> </s> <unk>", "naïve café ﬁ Å",
    "日本語 テキスト 🎉🎉 x", "\x00\x01 nul", "a b　c d", "ΑΣ Σ ΟΔΟΣ. ΣΑ", "<|endoftext|> x<|startoftext|>y <|endof text|>", "don't we'll I'm 'S X'S",
    "x" * 5000, "word " * 3000, "é ́ e ́", "\n", "\n\na", "a\n", "½ ² 123 4.5e6 --- ...", "tail   ", "a.Σ Σa. J̌. A. B, ΑΣ.Α ΑΣ. x.y. z.. end.", "İstanbul İ ǅ ŉ a", "a.", ".", "?", "b!\n",
]


def corpus(seed: int = 0) -> list[str | None]:
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "the", "▁", "é", "🎉", ".", "1", "ing", "\t"]
    return TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(200)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string").repartition(3)


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=chunks.tokenizer_path("piece_bpe_32k.model"))


def test_digests_equal_the_library(frame):
    sp, texts = library(), corpus()
    for r in sentence_pieces.digests(frame).collect():
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids), texts[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest(), texts[r["doc_id"]]


def test_encoded_returns_ids_and_text(frame):
    sp, texts = library(), corpus()
    for r in sentence_pieces.encoded(frame).collect():
        ids = sp.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids)


@pytest.mark.parametrize("model", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_equal_the_library(frame, model):
    from tokenizers import Tokenizer

    texts = corpus()
    count = (lambda t: len(library().encode(t))) if model.endswith("model") else (lambda t, k=Tokenizer.from_file(chunks.tokenizer_path(model)): len(k.encode(t, add_special_tokens=False).ids))
    for r in sentence_pieces.token_counts(frame, model, limit=100).collect():
        text = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), count(text)), text
        assert r["over_limit"] == (r["n_tokens"] > 100)


def test_small_tables(spark, monkeypatch):
    monkeypatch.setattr(chunks, "TABLE_CHUNKS", 3)
    monkeypatch.setattr(chunks, "GROUP_BYTES", 50)
    import numpy as np
    import pyarrow as pa

    sp = library()
    table = chunks.Table(lambda x: pa.array([len(i) for i in sentence_pieces.encode_words(sp, x)], pa.int32()))
    for text in ["a b c d e", "d e f g", "a a a", "zz"]:
        words, _ = sentence_pieces._words(pa.array([text]))
        codes, values = table.codes(words)
        assert int(np.sum(values.to_numpy()[codes])) == len(sp.encode(text))
        assert table.known is None or len(table.known) <= 3


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, digest string, n_tokens int")
    assert sentence_pieces.digests(empty).collect() == [] and sentence_pieces.token_counts(empty).collect() == []
    clash = spark.createDataFrame([(1, "x y", 7), (1, "x y", 7), (None, None, None)], "doc_id long, text string, n_tokens int")
    assert sorted(r["n_tokens"] for r in sentence_pieces.digests(clash).collect()) == [0, 2, 2]
