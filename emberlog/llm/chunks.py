"""Distinct-chunk tables: texts are cut where no token can cross, each distinct chunk is tokenised once, results go back by position.

A table belongs to one Python worker. It grows with the chunks that the worker meets, up to TABLE_CHUNKS entries, so that a worker's
memory is bounded whatever it reads.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from emberlog.llm import frames
from emberlog.llm.merges import Merges
from emberlog.llm.words import word_hashes

#: Entries of a table.
TABLE_CHUNKS = 600_000
#: Bytes of text whose chunks are looked up together.
GROUP_BYTES = 1 << 21
#: Distinct words that go through a library as one text.
JOINED = 1024


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: a path as it is, else a name that the public_tokenizers package knows."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def at_marker(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Spaces that follow another character of the same text: the white space marker there begins a new chunk.

    The marker's own character in a text counts as a space, so a run of both stays together.
    """
    cut = np.zeros(len(body), dtype=bool)
    if len(body):
        space = body == 0x20
        cut[1:] = space[1:] & ~space[:-1]
        marker = np.flatnonzero((body[:-3] == 0xE2) & (body[1:-2] == 0x96) & (body[2:-1] == 0x81)) + 3
        cut[marker] = False
        starts = offsets[:-1]
        cut[starts[starts < len(body)]] = False
    return cut


def at_white_space(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All ASCII white space."""
    return (body == 0x20) | ((body >= 0x09) & (body <= 0x0D))


def last_marks(body: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Places of a single . , ; : ! or ? between an ASCII letter and a cut or a text's end; a chunk of its own begins there.

    With only that mark behind it, no rule that looks at neighbours (composition, final sigma, contractions) can tell the difference.
    """
    if len(body) < 2:
        return np.zeros(0, dtype=np.int64)
    mark = np.flatnonzero(_MARKS[body[1:]]) + 1
    ends = np.append(cut[1:], True)
    ends[offsets[1:][offsets[1:] > 0] - 1] = True
    mark = mark[ends[mark] & _LETTERS[body[mark - 1]]]
    first = np.zeros(len(body) + 1, dtype=bool)
    first[offsets[:-1]] = True
    return mark[~first[mark]]


_MARKS, _LETTERS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARKS[list(b".,;:!?")] = True
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def split(texts: pa.Array, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], marks: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All chunks of all texts, without the bytes at which they are cut, and the n + 1 offsets of each text's chunks.

    marks: the last mark of a word is a chunk of its own (see last_marks).
    """
    body, offsets = frames.raw(texts)
    cut = cuts(body, offsets)
    gone = np.zeros(len(body) + 1, dtype=np.int32 if len(body) < 1 << 31 else np.int64)
    np.cumsum(cut, out=gone[1:])
    at = np.flatnonzero(cut)
    extra = last_marks(body, offsets, cut) if marks else np.zeros(0, dtype=np.int64)
    # a chunk ends at each cut and at the end of each text
    ends = np.concatenate([at, extra, offsets[1:]])
    order = np.argsort(ends, kind="stable")  # a cut at the last byte of a text comes before the text's end
    chunk_ends = ends[order] - gone[ends[order]]
    bounds = np.zeros(len(ends) + 1, dtype=np.int32)
    bounds[1:] = chunk_ends
    chunks = pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body[~cut])))
    per_text = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(gone[offsets[1:]] - gone[offsets[:-1]] + 1 + np.diff(np.searchsorted(extra, offsets)), out=per_text[1:])
    return chunks, per_text


class Table:
    """Values of distinct chunks met so far; encode gives the values of a list of chunks (arrow: of an Arrow array) as an Arrow array.

    Chunks are found by a sorted array of their hashes, and compared whole.
    """

    def __init__(self, encode: Callable[[list[str]], pa.Array] | Callable[[pa.Array], pa.Array], arrow: bool = False):
        self.encode = encode if arrow else lambda chunks: encode(chunks.to_pylist())
        self.known, self.values = None, None
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def codes(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """A row for each chunk, and the values by row.

        A full table stays as it is while it knows most of the chunks asked for, as frequent ones come early; others are encoded for the
        call alone. Else it starts anew with the chunks at hand.
        """
        coded = chunks.dictionary_encode()
        indices, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        body, ends = frames.raw(distinct)
        hashes = word_hashes(body, ends[:-1], ends[1:])
        if self.known is None or not len(self.known):
            return self._anew(distinct, hashes, indices)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = self.rows[place]
        hit = self.hashes[place] == hashes
        same = pc.equal(self.known.take(pa.array(rows)), distinct).to_numpy(zero_copy_only=False)
        missing = ~(hit & same)
        n = int(missing.sum())
        if not n:
            return rows[indices], self.values
        full = len(self.known) + n > TABLE_CHUNKS
        if full and 2 * n > len(distinct):
            return self._anew(distinct, hashes, indices)
        new = distinct.filter(pa.array(missing))
        rows[missing] = len(self.known) + np.arange(n)
        values = pa.concat_arrays([self.values, self.encode(new)])
        if not full:
            self._learn(pa.concat_arrays([self.known, new]), values, np.concatenate([self.hashes, hashes[missing]]), np.concatenate([self.rows, rows[missing]]))
        return rows[indices], values

    def _anew(self, distinct: pa.Array, hashes: np.ndarray, indices: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        values = self.encode(distinct)
        if len(distinct) <= TABLE_CHUNKS:
            self._learn(distinct, values, hashes, np.arange(len(distinct)))
        return indices, values

    def _learn(self, known: pa.Array, values: pa.Array, hashes: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.known, self.values, self.hashes, self.rows = known, values, hashes[order], rows[order]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's items."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def groups(batches: Iterator[pa.RecordBatch], limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts have about limit bytes; column 1 is the text."""
    for rows in batches:
        for start, stop in frames.pieces(rows.column(1), limit):
            yield rows.slice(start, stop - start)


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    """One table a worker, which its tasks share."""
    return WordIds(vocabulary)


class WordIds:
    """Ids of the tokenizers library for texts whose vocabulary drops white space, so that no token crosses it."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges.of(tokenizer_path(vocabulary))
        self.table = Table(self._encode, arrow=True)

    def _encode(self, chunks: pa.Array | list[str]) -> pa.Array:
        """Ids of each chunk. Runs of Latin letters and of marks are merged many at once (see merges), what is left goes to the library."""
        chunks = pa.array(chunks, pa.string()) if isinstance(chunks, list) else chunks
        if self.merges is None:
            return self._library(chunks.to_pylist())
        known, ids = self.merges(chunks)
        if known.all():
            return ids
        order = np.empty(len(chunks), dtype=np.int64)
        order[known] = np.arange(len(ids))
        order[~known] = len(ids) + np.arange(len(chunks) - len(ids))
        return pa.concat_arrays([ids, self._library(chunks.filter(pa.array(~known)).to_pylist())]).take(pa.array(order))

    def _library(self, chunks: list[str]) -> pa.Array:
        """Ids of each chunk. Chunks of letters alone are one pre-token each: many go through the library as one text, parted by spaces."""
        plain = [k for k, x in enumerate(chunks) if x.isalpha() or (len(x) == 1 and x in ".,;:!?")]
        lists, at = [], []
        for start in range(0, len(plain), JOINED):
            part = plain[start : start + JOINED]
            got = self.tokenizer.encode(" ".join([chunks[k] for k in part]), add_special_tokens=False)
            words = np.array(got.word_ids, dtype=np.int64)
            if len(words) and words[-1] + 1 == len(part):
                bounds = np.zeros(len(part) + 1, dtype=np.int32)
                np.cumsum(np.bincount(words, minlength=len(part)), out=bounds[1:])
                lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(got.ids, pa.uint32())))
            else:  # lower case took a letter apart
                lists.append(self._each([chunks[k] for k in part]))
            at += part
        others = sorted(set(range(len(chunks))) - set(plain)) if len(plain) < len(chunks) else []
        lists.append(self._each([chunks[k] for k in others]))
        order = np.empty(len(chunks), dtype=np.int64)
        order[np.array(at + others, dtype=np.int64)] = np.arange(len(chunks))
        return pa.concat_arrays(lists).take(pa.array(order))

    def _each(self, chunks: list[str]) -> pa.Array:
        bounds, ids = np.zeros(len(chunks) + 1, dtype=np.int32), []
        for start in range(0, len(chunks), 8192):
            for k, e in enumerate(self.tokenizer.encode_batch_fast(chunks[start : start + 8192], add_special_tokens=False), start + 1):
                got = e.ids
                bounds[k] = len(got)
                ids.extend(got)
        np.cumsum(bounds, out=bounds)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.uint32()))

    def __call__(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """All ids with the end id after each text, the n + 1 offsets, the chunks, their per-text offsets and the ids before each chunk's end."""
        chunks, per_text = split(texts, at_white_space, marks=True)
        rows, values = self.table.codes(chunks)
        taken = values.take(pa.array(rows))
        flat = taken.flatten().to_numpy(zero_copy_only=False)
        bounds = np.asarray(taken.offsets, dtype=np.int64)
        chunk_ends = bounds[1:] - bounds[0]
        text_ends = chunk_ends[per_text[1:] - 1]
        offsets = np.zeros(len(per_text), dtype=np.int64)
        offsets[1:] = text_ends
        if end is not None:
            flat = np.insert(flat, text_ends, end)
            offsets += np.arange(len(offsets))
            chunk_ends = chunk_ends + np.repeat(np.arange(len(per_text) - 1), np.diff(per_text))
        return flat.astype(np.uint32, copy=False), offsets, chunks, per_text, chunk_ends
