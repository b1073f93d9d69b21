"""Language identification with hyperdimensional profiles (8).

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each rotated by its place;
a document bundles (adds) the vectors of all its n-grams; a language's prototype bundles the unit vectors of its training documents.
The language whose prototype has the largest cosine (to six places) with the document is the prediction, ties to the smaller name. A document's vector
is the sum over its distinct n-grams of count x vector, so each distinct n-gram is bound once a batch.

Null texts and texts without a letter are `und` with score 0. A text whose letters share nothing with any prototype scores 0 too and
gets the first name. Without a training document all is `und`. Null ids are never held out. Rows may repeat, and each has its own result.
Texts are read whole, very long ones too: a task holds one's n-grams and their counts. An empty table gives an empty result, and no
languages. Columns beside id, text and language play no part, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import frames
from emberlog.llm.words import mix

DIMENSIONS = 512
GRAM = 3
#: About how many labelled documents the prototypes are learnt from; all, where there are fewer.
MAX_TRAINING = 30_000
#: About how many of them each language has at least, or all of its documents where there are fewer.
LEAST_TRAINING = 100
UNKNOWN = "und"


class Encoder:
    """Document vectors. The letters' vectors follow from the code points alone, so all workers agree."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.codes = np.full(0x110000, -1, dtype=np.int32)  # code point -> letter number; 0: between words
        self.letters = [self._letter(0)]
        self.vectors = np.zeros((0, dimensions), dtype=np.float32)
        self.keys = np.zeros(0, dtype=np.int64)

    def _letter(self, point: int) -> np.ndarray:
        seeds = mix(np.arange(self.dimensions // 64, dtype=np.uint64) + np.uint64((point + 1) * 4096))
        return np.unpackbits(seeds.view(np.uint8)).astype(np.int8) * 2 - 1

    def _numbers(self, points: np.ndarray) -> np.ndarray:
        found = self.codes[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]).tolist():
                low = chr(p).lower()
                if not unicodedata.category(chr(p)).startswith("L"):
                    self.codes[p] = 0
                elif len(low) == 1 and low != chr(p):
                    self.codes[p] = self._numbers(np.array([ord(low)]))[0]
                else:
                    self.codes[p] = len(self.letters)
                    self.letters.append(self._letter(p))
            found = self.codes[points]
        return found

    def _bound(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of n-grams by their keys."""
        table = np.stack(self.letters)
        out = np.ones((len(keys), self.dimensions), dtype=np.int8)
        for place in range(self.gram):
            number = (keys >> (20 * (self.gram - 1 - place))) & 0xFFFFF
            out *= np.roll(table, self.gram - 1 - place, axis=1)[number]
        return out.astype(np.float32)

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows of self.vectors for sorted distinct keys; the table starts anew when it would pass 50,000 n-grams."""
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        if new.any():
            if len(self.keys) + new.sum() > 50_000:
                self.keys, self.vectors = keys, self._bound(keys)
            else:
                both = np.concatenate([self.keys, keys[new]])
                order = np.argsort(both, kind="stable")
                self.vectors = np.concatenate([self.vectors, self._bound(keys[new])])[order]
                self.keys = both[order]
            place = np.searchsorted(self.keys, keys)
        return place

    def grams(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Distinct n-gram keys and counts of each text, None without a letter."""
        for text in texts.to_pylist():
            points = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
            numbers = self._numbers(points)
            letters = numbers > 0
            if not letters.any():
                yield None
                continue
            keep = letters | np.concatenate([[False], letters[:-1]])  # one gap between words, one at either end
            numbers = np.concatenate([[0], numbers[keep], [0][: int(letters[-1])]]).astype(np.int64)
            key = numbers[: len(numbers) - self.gram + 1]
            for place in range(1, self.gram):
                key = (key << 20) | numbers[place : len(numbers) - self.gram + 1 + place]
            yield np.unique(key, return_counts=True)

    def documents(self, texts: pa.Array) -> np.ndarray:
        """A unit vector for each text, zero without a letter."""
        return self.counted(texts)[0]

    def counted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' unit vectors and their numbers of n-grams."""
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        found = list(self.grams(texts))
        some = [k for k, x in enumerate(found) if x is not None]
        if some:
            merged = np.unique(np.concatenate([found[k][0] for k in some]))
            self._rows(merged)
        for k in some:
            keys, counts = found[k]
            out[k] = counts.astype(np.float32) @ self.vectors[np.searchsorted(self.keys, keys)]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        sizes = np.array([0 if x is None else x[1].sum() for x in found], dtype=np.int64)
        return np.divide(out, norms, out=out, where=norms > 0), sizes


def prototypes(df: DataFrame, max_training: int = MAX_TRAINING, dimensions: int = DIMENSIONS, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from about max_training rows of df that crc32(key) picks; rows with null text or language don't count.

    Of a language of which that would pick fewer than LEAST_TRAINING, about as many are picked, or all there are.

    Partial bundles are added up on the executors; one vector for each language and partition comes together at the end.
    """
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.crc32(F.reverse(F.col(f"`{key_col}`").cast("string"))), F.lit(0)).alias("key"))
    rows = rows.filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}  # languages
    total = sum(counts.values())
    if total > max_training:
        bounds = [(lang, int((1 << 32) * min(1, max(max_training / total, LEAST_TRAINING / n)))) for lang, n in counts.items()]
        rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").filter("key < bound")
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(dimensions), {}
        for batch in batches:
            for start, stop in frames.pieces(batch.column(0)):
                vectors = encoder.documents(batch.column(0).slice(start, stop - start))
                langs = np.array(batch.column(1).slice(start, stop - start).to_pylist(), dtype=object)
                for lang in sorted(set(langs.tolist())):
                    total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        yield frames.batch(schema, lang=list(total), part=[0] * len(total), vector=[v.tolist() for v in total.values()])

    partial = rows.select("text", "lang").mapInArrow(run, "lang string, part int, vector array<double>")
    summed = partial.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in summed.toLocalIterator():  # languages x dimensions
        found.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["value"]
    names = sorted(found)
    table = np.array([found[x] for x in names]).reshape(len(names), dimensions)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return names, np.divide(table, norms, out=np.zeros_like(table), where=norms > 0)


def identify(df: DataFrame, names: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine with the best prototype, 0 to 1) and n_grams of each row."""
    docs = frames.documents(df, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_grams", pa.int64())])
    matrix = np.asarray(table, dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(matrix.shape[1] if len(names) else DIMENSIONS)
        for batch in batches:
            for start, stop in frames.pieces(batch.column(1)):
                rows = batch.slice(start, stop - start)
                vectors, sizes = encoder.counted(rows.column(1))
                some = vectors.any(axis=1)
                if names:
                    cosines = vectors @ matrix.T
                    best = np.round(cosines, 6).argmax(axis=1)
                    score = np.where(some, np.clip(cosines.max(axis=1).astype(np.float64), 0, 1), 0.0)
                    pred = [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
                else:
                    score, pred = np.zeros(len(vectors)), [UNKNOWN] * len(vectors)
                yield frames.batch(schema, doc_id=rows.column(0), lang_pred=pred, score=score, n_grams=sizes)

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, n_grams long")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_training: int = MAX_TRAINING) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, learnt from the rows that aren't held out."""
    names, table = prototypes(df.filter(~held_out(id_col)), max_training, text_col=text_col, lang_col=lang_col, key_col=id_col)
    return identify(df, names, table, id_col, text_col).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score")
