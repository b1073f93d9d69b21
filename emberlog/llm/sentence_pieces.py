"""SentencePiece encoding and decoding by a table of distinct marked words (7), and token counts from the same table (9).

No piece of a supported vocabulary has a white space marker behind another character, so no merge crosses the place where a run of
markers begins. A text is cut there; each distinct marked word is segmented once a task, and its ids return by position. A vocabulary
that has such a piece, or a normaliser that changes text, is refused.

Null and empty texts have no ids. Very long texts are handled whole. Rows may repeat; each has its own result. Null ids stay null. An empty
table gives an empty result. Columns beside id and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import chunks, frames

MARK = "▁"


@lru_cache(maxsize=2)
def processor(model: str):
    """The loaded vocabulary, once a worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=chunks.tokenizer_path(model))
    crossing = next((p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)), None)
    probe = "a  b ääﬁ "
    if crossing is not None or sp.decode(sp.encode(probe)) != probe or sp.encode("a") != sp.encode(" a")[-len(sp.encode("a")) :] and sp.piece_to_id(MARK) == sp.unk_id():
        raise ValueError(f"{model}: marked words can't be segmented apart ({crossing!r})")
    return sp


def encode_words(sp, words: list[str]) -> list[list[int]]:
    """Ids of each marked word, given without the marker that the library puts before a text; a marker alone is the empty word."""
    alone = [sp.piece_to_id(MARK)]
    return [ids or alone for ids in sp.encode(words, num_threads=1)]


def encoded(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each row."""
    docs = frames.documents(df, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        table = chunks.Table(lambda words: _pairs(sp, words))
        for rows in chunks.groups(batches):
            words, per_text = _words(rows.column(1))
            codes, values = table.codes(words)
            codes = pa.array(codes)
            lists = values.field("ids").take(codes)
            bounds = np.asarray(lists.offsets, dtype=np.int64)[per_text]
            body, ends = frames.raw(values.field("text").take(codes))
            whole, ends = body.tobytes(), ends[per_text].tolist()
            decoded = [whole[a + 1 : b].decode() for a, b in zip(ends[:-1], ends[1:])]  # the first word's space goes
            yield frames.batch(schema, doc_id=rows.column(0), ids=pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), lists.flatten()), decoded=decoded)

    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _pairs(sp, words: list[str]) -> pa.StructArray:
    """ids and the decoded word with its marker's space before it."""
    ids = encode_words(sp, words)
    bounds = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=bounds[1:])
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array([i for x in ids for i in x], pa.int32()))
    return pa.StructArray.from_arrays([lists, pa.array([" " + x for x in sp.decode(ids)], pa.string())], ["ids", "text"])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Marked words; an empty text has none."""
    words, per_text = chunks.split(texts, chunks.at_marker)
    empty = frames.byte_lengths(texts) == 0
    if empty.any():
        keep = np.ones(len(words), dtype=bool)
        keep[per_text[:-1][empty]] = False
        words = words.filter(pa.array(keep))
        per_text = np.concatenate([[0], np.cumsum(np.diff(per_text) - empty)])
    return words, per_text


def digests(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of each row, without materialising id lists in the JVM."""
    docs = frames.documents(df, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def values(sp, words: list[str]) -> pa.StructArray:
        ids = encode_words(sp, words)
        return pa.StructArray.from_arrays(
            [pa.array([len(x) for x in ids], pa.int32()), pa.array([f"{','.join(map(str, x))}," for x in ids], pa.string()), pa.array([" " + x for x in sp.decode(ids)], pa.string())], ["n", "ids", "text"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        table = chunks.Table(lambda words: values(sp, words))
        for rows in chunks.groups(batches):
            words, per_text = _words(rows.column(1))
            codes, found = table.codes(words)
            n = chunks.sums(found.field("n").to_numpy()[codes], per_text)
            shas = []
            for name in ("ids", "text"):
                body, ends = frames.raw(found.field(name).take(pa.array(codes)))
                view, skip = memoryview(body), name == "text"
                ends = ends[per_text]
                shas.append([hashlib.sha256(view[a + skip : b - (not skip)] if b > a else b"").hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
            yield frames.batch(schema, doc_id=rows.column(0), n_tokens=n, ids_sha256=shas[0], decoded_sha256=shas[1])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(df: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    Pieces are counted once for each distinct pre-token of a task; each document's pre-token frequencies are joined to these counts and
    summed. No ids are kept beyond the count of one pre-token. For a .json vocabulary the pre-tokens are the runs between white space.
    """
    docs = frames.documents(df, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.endswith(".json"):
            words = chunks.word_ids(model)
            table = chunks.Table(lambda x: pa.array(np.diff(np.asarray(words._encode(x).offsets)), pa.int32()))
            cut = lambda texts: chunks.split(texts, chunks.at_white_space, marks=True)
        else:
            sp = processor(model)
            table = chunks.Table(lambda x: pa.array([len(ids) for ids in encode_words(sp, x)], pa.int32()))
            cut = _words
        for rows in chunks.groups(batches):
            pre_tokens, per_text = cut(rows.column(1))
            codes, counts = table.codes(pre_tokens)
            counts = counts.to_numpy()[codes]
            yield frames.batch(schema, doc_id=rows.column(0), n_bytes=frames.byte_lengths(rows.column(1)), n_tokens=chunks.sums(counts, per_text))

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
