"""Substring dedup over bytes with suffix arrays (1).

A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document with a smaller id, or further left in
the same one. Strings are judged on the input and never cross documents.

Each string (window) is represented by the least hashed 8 bytes among its first REACH places; equal windows agree on it. Windows whose
representative, with the bytes that follow it in all of them, occurs once in the corpus can't repeat and go no further. The others go, by
representative, to the partitions that sort them: neighbouring windows with one representative travel as one stretch of text, equal
stretches of a task as one with the earliest place. A partition concatenates its stretches from their representatives on, as ranks of
BLOCK bytes, builds the suffix array by Lyndon grouping (emberlog.llm.suffixes), and reads from it and the common prefixes of
neighbours which stretches agree how far to the right; what lies left of the representative is sorted likewise. Of windows that agree
on both sides the earliest stays and the others are marked.

Null and empty texts have no bytes; texts shorter than `length` are left alone; very long ones are handled whole. Rows with a null or
repeated id are documents in the order of (id, text), so the later of equal rows repeats the earlier. An empty table gives an empty
result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import frames, repeats
from emberlog.llm.suffixes import suffix_array
from emberlog.llm.words import mix

LENGTH = 100
#: A window's representative starts among its first REACH bytes.
REACH = 76
#: Bytes that a symbol of the suffix array stands for.
BLOCK = 16
#: Stretches that a task sorts together, and stretches that it gathers before it drops equal ones.
SORTED, GATHERED = 20_000, 300_000

_INDEX = np.uint64((1 << 32) - 1)
STRETCH = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
STRETCH_DDL = "key long, doc_id long, at long, before int, n int, body binary"
SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _eights(body: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number; past the end they are zeros."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    return np.ndarray((len(body),), dtype="<u8", buffer=padded.data, strides=(1,)).copy()


def _ranks(eights: np.ndarray) -> np.ndarray:
    return (mix(eights + np.uint64(1)) & ~_INDEX) | (np.arange(len(eights), dtype=np.uint64) & _INDEX)


def _keys(eights: np.ndarray, at: np.ndarray, reach: int, length: int) -> np.ndarray:
    """Hash of what all windows with the representative at a place hold from there on: length - reach + 1 bytes."""
    common = length - reach + 1
    key = np.full(len(at), common, dtype=np.uint64)
    for offset in [*range(0, common - 8, 8), max(common - 8, 0)]:
        value = eights[at + offset]
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (value if common >= 8 else value & np.uint64((1 << (8 * common)) - 1)))
    return key


def _least(ranks: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ranks of each place and the reach - 1 places after it."""
    least, step = ranks.copy(), 1
    while step * 2 <= reach:
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    rest = reach - step
    if rest:
        least[: len(least) - rest] = np.minimum(least[: len(least) - rest], least[rest:])
    return least


def _windows(offsets: np.ndarray, length: int) -> np.ndarray:
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    return np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _anchors(batches: Iterator[pa.RecordBatch], length: int, reach: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one representative: key, doc_id, first window, number of windows."""
    rows = repeats.Rows()
    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            body, offsets = frames.raw(batch.column(1).slice(start, stop - start))
            ids = batch.column(0).slice(start, stop - start).to_numpy()
            windows = _windows(offsets, length)
            if not len(windows):
                continue
            eights = _eights(body)
            place = (_least(_ranks(eights), reach)[windows] & _INDEX).astype(np.int64)
            new = np.ones(len(windows), dtype=bool)
            new[1:] = place[1:] != place[:-1]
            at = np.flatnonzero(new)
            own = np.searchsorted(offsets, windows[at], side="right") - 1
            rows.add(_keys(eights, place[at], reach, length), ids[own], windows[at] - offsets[own], np.diff(np.append(at, len(windows))))
        yield from rows.out(False)
    yield from rows.out(True)


def _spans(doc_id, start, stop) -> pa.RecordBatch:
    """Finished spans travel as stretches without text, under keys of their own; those that touch go as one."""
    order = np.lexsort((start, doc_id))
    doc_id, start, stop = doc_id[order], start[order], stop[order]
    base = np.cumsum(np.append(0, doc_id[1:] != doc_id[:-1])) << 40  # documents apart
    reach = np.maximum.accumulate(stop + base)
    new = np.append(True, (start + base)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    doc_id, start, stop = doc_id[at], start[at], (reach - base)[np.append(at[1:], len(new)) - 1]
    key = mix(mix(doc_id.view(np.uint64)) + start.astype(np.uint64)).view(np.int64)
    return frames.batch(STRETCH, key=key, doc_id=doc_id, at=start, before=np.zeros(len(key), np.int32), n=(stop - start).astype(np.int32), body=pa.nulls(len(key), pa.binary()))


class Stretches:
    """Stretches of a task; equal ones are kept once, with the earliest place, and the others' windows are finished spans."""

    def __init__(self, length: int):
        self.length, self.rows = length, []

    def unique(self) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.rows.sort(key=lambda r: (r[1], r[2]))
        first: dict[tuple, tuple] = {}
        doc, start, stop = [], [], []
        for r in self.rows:
            if first.setdefault((r[5], r[3]), r) is not r:
                doc.append(r[1])
                start.append(r[2] - r[3])
                stop.append(r[2] - r[3] + r[4] - 1 + self.length)
        self.rows = []
        return list(first.values()), tuple(np.array(x, dtype=np.int64) for x in (doc, start, stop))


def _stretches(batches: Iterator[pa.RecordBatch], length: int, reach: int) -> Iterator[pa.RecordBatch]:
    """Text of candidate windows from rows of doc_id, text, and lists of first windows and their numbers."""
    held = Stretches(length)

    def out() -> Iterator[pa.RecordBatch]:
        rows, spans = held.unique()
        for k in range(0, len(rows), 20_000):
            key, doc, at, before, n, body = zip(*rows[k : k + 20_000])
            yield frames.batch(STRETCH, key=key, doc_id=doc, at=at, before=before, n=n, body=pa.array(body, pa.binary()))
        if len(spans[0]):
            yield _spans(*spans)

    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            part = batch.slice(start, stop - start)
            body, offsets = frames.raw(part.column(1))
            owner = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.column(2).offsets, dtype=np.int64)))
            first, n = part.column(2).flatten().to_numpy() + offsets[owner], part.column(3).flatten().to_numpy()
            eights = _eights(body)
            ranks = _ranks(eights)
            place = np.empty(len(first), dtype=np.int64)
            for k in range(0, len(first), 20_000):
                place[k : k + 20_000] = (ranks[first[k : k + 20_000, None] + np.arange(reach)].min(axis=1) & _INDEX).astype(np.int64)
            keys = _keys(eights, place, reach, length).view(np.int64)
            whole = body.tobytes()
            texts = [whole[a:b] for a, b in zip(first.tolist(), (first + n - 1 + length).tolist())]
            held.rows += zip(keys.tolist(), part.column(0).to_numpy()[owner].tolist(), (place - offsets[owner]).tolist(), (place - first).tolist(), n.tolist(), texts)
            if len(held.rows) > GATHERED:
                yield from out()
    yield from out()


def _blocks(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, padded with zeros to whole blocks; their lengths; the rank of each block among all."""
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    width = max(1, -(-int(sizes.max(initial=1)) // BLOCK)) * BLOCK
    matrix = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), dtype=np.uint8).reshape(len(rows), width)
    words = matrix.view(">u8").astype(np.uint64).reshape(len(rows), -1, BLOCK // 8)
    valid = np.clip(sizes[:, None] - np.arange(0, width, BLOCK)[None, :], 0, BLOCK)
    columns = [words[:, :, k].ravel() for k in range(BLOCK // 8)] + [valid.ravel()]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return matrix, sizes, rank.reshape(len(rows), -1)


def _common(matrix: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row in an order with the one before it; 0 for the first."""
    out = np.zeros(len(order), dtype=np.int64)
    a, b = matrix[order[1:]], matrix[order[:-1]]
    differ = a != b
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    out[1:] = np.minimum(out[1:], np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return out


def _sorted_by_suffixes(sizes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of the rows of blocks, from the suffix array of all rows with a separator behind each."""
    used = -(-sizes // BLOCK)
    blocks = rank.shape[1]
    text = np.ones((len(sizes), blocks + 1), dtype=np.int64)
    text[:, :blocks] = rank + 2
    keep = np.ones_like(text, dtype=bool)
    keep[:, :blocks] = np.arange(blocks)[None, :] < used[:, None]
    starts = np.concatenate([[0], np.cumsum(used + 1)])
    flat = np.append(text[keep], 0)
    found = np.array(suffix_array(flat.tolist()), dtype=np.int64)
    row = np.full(len(flat), -1, dtype=np.int64)
    row[starts[:-1]] = np.arange(len(sizes))
    found = row[found]
    return found[found >= 0]


def repeated_windows(rows: list[tuple], length: int) -> np.ndarray:
    """For stretches in order of place, by row and bytes before the representative: whether an equal window is in an earlier row."""
    before, n = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    right, sizes, rank = _blocks([r[5][r[3] :] for r in rows])
    order = _sorted_by_suffixes(sizes, rank)
    common = _common(right, sizes, order)
    left, left_sizes, left_rank = _blocks([r[5][: r[3]][::-1] for r in rows])
    left_order = _sorted_by_suffixes(left_sizes, left_rank)
    left_common = _common(left, left_sizes, left_order)
    marked = np.zeros((len(rows), int(before.max(initial=0)) + 1), dtype=bool)
    group, left_group = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
    for d in range(marked.shape[1]):
        own = np.flatnonzero((before >= d) & (before - n < d))
        if len(own) < 2:
            continue
        group[order] = np.cumsum(common < length - d)
        left_group[left_order] = np.cumsum(left_common < d)
        key = (group[own] << 32) | left_group[own]
        by_key = np.argsort(key, kind="stable")
        again = key[by_key][1:] == key[by_key][:-1]
        marked[own[by_key[1:][again]], d] = True
    return marked


def _sort(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from all stretches of a partition."""
    held = Stretches(length)
    for batch in batches:
        done = pa.compute.is_null(batch.column(5)).to_numpy(zero_copy_only=False)
        if done.any():
            spans = batch.filter(pa.array(done))
            start = spans.column(2).to_numpy()
            yield frames.batch(SPANS, doc_id=spans.column(1), start=start, stop=start + spans.column(4).to_numpy())
        held.rows += zip(*(c.to_pylist() for c in batch.filter(pa.array(~done)).columns))
    rows, spans = held.unique()
    if len(spans[0]):
        yield frames.batch(SPANS, doc_id=spans[0], start=spans[1], stop=spans[2])
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    start = 0
    while start < len(rows):
        stop = min(len(rows), start + SORTED)
        while stop < len(rows) and rows[stop][0] == rows[stop - 1][0]:
            stop += 1
        part = sorted(rows[start:stop], key=lambda r: (r[1], r[2]))
        start = stop
        marked = repeated_windows(part, length)
        edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        doc, at = np.array([r[1] for r in part], dtype=np.int64), np.array([r[2] for r in part], dtype=np.int64)
        if len(row):
            yield frames.batch(SPANS, doc_id=doc[row], start=at[row] - high, stop=at[row] - low + length)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, bytes]]]]:
    """Rows of doc_id, text and lists of span starts and ends (null: none), with (bytes, removed, runs, what stays) of each."""
    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            part = batch.slice(start, stop - start)
            body, offsets = frames.raw(part.column(1))
            out = []
            for k, (a, b, starts) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(2))):
                text = body[a:b]
                if not starts.is_valid:
                    out.append((b - a, 0, 0, text.tobytes()))
                    continue
                gone = repeats.covered(starts.values.to_numpy(), part.column(3)[k].values.to_numpy(), b - a)
                runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((b - a, int(gone.sum()), runs, text[~gone].tobytes()))
            yield part, out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for part, out in _kept(batches):
        yield frames.batch(schema, doc_id=part.column(0), n_bytes=[x[0] for x in out], n_removed=[x[1] for x in out], n_spans=[x[2] for x in out], kept_sha256=[hashlib.sha256(x[3]).hexdigest() for x in out])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("body", pa.binary())])
    for part, out in _kept(batches):
        yield frames.batch(schema, doc_id=part.column(0), n_bytes=[x[0] for x in out], n_removed=[x[1] for x in out], n_spans=[x[2] for x in out], body=pa.array([x[3] for x in out], pa.binary()))


def _reach(length: int) -> int:
    if length < 8:
        raise ValueError("length must be 8 or more")
    return min(REACH, length - 7)  # the 8 hashed bytes lie inside the window


def repeated_spans(docs: DataFrame, placed: DataFrame, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """doc_id, start and stop of spans of docs (doc_id, text; placed: the same by doc_id) that repeat something earlier; spans may overlap."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = repeats.by_document(repeats.repeated(docs.mapInArrow(lambda it: _anchors(it, length, reach), repeats.DDL)), "at", "n")
    stretches = placed.join(candidates, "doc_id").select("doc_id", "text", "at", "n").mapInArrow(lambda it: _stretches(it, length, reach), STRETCH_DDL)
    return stretches.repartition(parts, "key").mapInArrow(lambda it: _sort(it, length), "doc_id long, start long, stop long")


def _marked(docs: DataFrame, length: int, reach: int) -> DataFrame:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.filter("doc_id is not null").repartition(parts, "doc_id")  # the joins would put this filter below one use of the exchange
    spans = repeats.by_document(repeated_spans(docs, placed, length, reach), "start", "stop")
    return placed.join(spans, "doc_id", "left").select("doc_id", "text", "start", "stop")


def removed_bytes(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    docs, restore = frames.unique_ids(frames.documents(df, id_col, text_col))
    return restore(_marked(docs, length, _reach(length)).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def deduplicated(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and body (the bytes that stay, which may break characters) of each row."""
    docs, restore = frames.unique_ids(frames.documents(df, id_col, text_col))
    return restore(_marked(docs, length, _reach(length)).mapInArrow(_bodies, "doc_id long, n_bytes long, n_removed long, n_spans long, body binary"))
