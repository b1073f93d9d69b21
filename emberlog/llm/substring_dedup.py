"""Substring dedup over words by recompression (3).

A document is a string of word symbols. Each round replaces short runs of one symbol by a run symbol and then pairs (left, right) by a pair
symbol, where a bit of a symbol's name says whether it is left or right in that round. A name is the 64-bit hash of what it stands for, so
equal content has the same name in all documents and partitions without a table of names. Beside its words each symbol carries the span
of words that its making depended on: wherever that span occurs, the symbol occurs. A window of `window` words therefore holds the same
symbols, of those whose span it holds whole, at each of its occurrences. Of these at the highest level that has any, the one with the
smallest name is the window's representative.

Only windows whose representative occurs more than once (shared high-level symbols) can repeat. Names of symbols are 64 bits wide, so two
contents may share one; that adds candidates and never loses any. These windows are verified by the SHA-256 (128 bits of it) of their word
sequence. A word that a repeated window covers is removed. Windows are judged on the input.

Null and empty texts have no words. Texts with fewer words than a window are left alone. Very long texts are handled whole. Rows with a
null or repeated id are documents in the order of (id, text), so equal rows repeat each other. An empty table gives an empty result.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import frames, repeats
from emberlog.llm.words import joined_words, mix, owners, powers, prefix_hash, span_hash, word_hashes, word_spans

WINDOW = 35
ROUNDS = 3
#: A longer run keeps its symbols: windows inside it could not see where it ends.
LONGEST_RUN = 3
_RUN, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


_PLACE = np.uint64((1 << 32) - 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TURNS = mix(np.arange(64, dtype=np.uint64) + _PAIR)


class Level:
    """Symbols of a batch of documents: name, first word, the span of words they depend on, and their document."""

    __slots__ = ("name", "start", "low", "high", "doc", "total")

    def __init__(self, name, start, low, high, doc, total):
        self.name, self.start, self.low, self.high, self.doc, self.total = name, start, low, high, doc, total

    def __len__(self) -> int:
        return len(self.name)


def _neighbours(x: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether the symbol before and after is of the same document; their spans' ends, one word beyond the document where there is none."""
    same = x.doc[1:] == x.doc[:-1]
    before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
    low, high = x.start - 1, np.append(x.start[1:], x.total) + 1
    low[1:][same], high[:-1][same] = x.low[:-1][same], x.high[1:][same]
    return before, after, low, high


def runs(x: Level) -> Level:
    """Runs of 2 to LONGEST_RUN equal symbols become one."""
    n = len(x)
    if not n:
        return x
    begins = np.ones(n, dtype=bool)
    begins[1:] = (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, n))
    _, _, low, high = _neighbours(x)
    last = at + length - 1
    run_low, run_high = low[at], high[last]  # what stands on both sides of a run shows where it ends
    short = length <= LONGEST_RUN
    name = np.where(length == 1, x.name[at], mix(x.name[at] + length.astype(np.uint64) * _RUN))
    if short.all():
        return Level(name, x.start[at], run_low, run_high, x.doc[at], x.total)
    # a symbol of a long run depends on that many symbols from it on, or on the run's last ones and what follows
    keep = begins | np.repeat(~short, length)
    of = np.repeat(np.arange(len(at)), length)[keep]
    index = np.flatnonzero(keep)
    left = index + LONGEST_RUN
    inside = left <= last[of]
    far = np.where(inside, np.minimum(left, n - 1), last[of])
    near = np.where(inside, index, np.maximum(last[of] - LONGEST_RUN, 0))
    small = short[of]
    return Level(
        np.where(small, name[of], x.name[index]), x.start[index], np.where(small, run_low[of], x.low[near]),
        np.where(small, run_high[of], np.where(inside, x.high[far], run_high[of])), x.doc[index], x.total,
    )


def pairs(x: Level, turn: int) -> Level:
    """Each left symbol with a right one behind it becomes one with it."""
    n = len(x)
    if not n:
        return x
    right = (mix(x.name + _TURNS[turn]) >> np.uint64(63)) == 1
    before, after, low, high = _neighbours(x)
    head = np.zeros(n, dtype=bool)
    head[:-1] = ~right[:-1] & right[1:] & after[:-1]
    tail = np.concatenate([[False], head[:-1]])
    follow = np.minimum(np.arange(n) + 1, n - 1)
    name = np.where(head, mix(mix(x.name) + x.name[follow] * _PAIR + np.uint64(turn)), x.name)
    new_high = np.where(~right, high, x.high)  # a left symbol's fate shows in the one behind it
    new_low = np.where(right, low, x.low)
    keep = ~tail
    return Level(name[keep], x.start[keep], new_low[keep], new_high[keep], x.doc[keep], x.total)


def levels(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """Symbols after 0, 1, ... rounds; level 0 is the words, each of which depends on itself alone."""
    place = np.arange(len(words))
    out = [Level(words, place, place, place + 1, doc, len(words))]
    for turn in range(rounds):
        out.append(pairs(runs(out[-1]), turn))
    return out


def representatives(found: list[Level], windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows by their first words: the representative's key, and a number for its place (level and symbol).

    The key names the symbol and all words that its making depended on, which every window with this representative holds.
    """
    prefix = prefix_hash(found[0].name)
    inverse = powers(len(prefix), _INVERSE)
    key = np.zeros(len(windows), dtype=np.uint64)
    place = np.full(len(windows), -1, dtype=np.int64)
    for height in range(len(found) - 1, -1, -1):
        open_ = np.flatnonzero(place < 0)
        if not len(open_):
            break
        x = found[height]
        begin = np.searchsorted(x.low, windows[open_])
        end = np.searchsorted(x.high, windows[open_] + window, side="right")
        some = end > begin
        open_, begin, end = open_[some], begin[some], end[some]
        if not len(open_):
            continue
        rank = (x.name & ~_PLACE) | np.arange(len(x), dtype=np.uint64)  # smallest name, leftmost
        least = [rank]
        step = 1
        while step * 2 <= window:
            last = least[-1]
            both = last.copy()
            both[:-step] = np.minimum(last[:-step], last[step:])
            least.append(both)
            step *= 2
        size = np.frexp((end - begin).astype(np.float64))[1] - 1
        best = np.zeros(len(open_), dtype=np.uint64)
        for k in np.unique(size).tolist():
            m = size == k
            best[m] = np.minimum(least[k][begin[m]], least[k][end[m] - (1 << k)])
        at = (best & _PLACE).astype(np.int64)
        key[open_] = mix(x.name[at] + np.uint64(height)) + span_hash(prefix, x.low[at], x.high[at], inverse)
        place[open_] = at * 8 + height
    return key, place


def _starts(offsets: np.ndarray, window: int) -> np.ndarray:
    """First words of all windows of documents by their words' offsets."""
    count = np.maximum(np.diff(offsets) - window + 1, 0)
    first = np.repeat(offsets[:-1], count)
    return first + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _anchors(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one representative: key, doc_id, first window, number of windows."""
    rows = repeats.Rows(merge=True)
    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            body, offsets = frames.raw(batch.column(1).slice(start, stop - start))
            ids = batch.column(0).slice(start, stop - start).to_numpy()
            begins, ends, bounds = word_spans(body, offsets)
            windows = _starts(bounds, window)
            if not len(windows):
                continue
            doc = owners(bounds)
            key, place = representatives(levels(word_hashes(body, begins, ends), doc, rounds), windows, window)
            new = np.ones(len(windows), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[windows[1:]] != doc[windows[:-1]])
            at = np.flatnonzero(new)
            own = doc[windows[at]]
            rows.add(key[at], ids[own], windows[at] - bounds[own], np.diff(np.append(at, len(windows))))
        yield from rows.out(False)
    yield from rows.out(True)


def _named(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Names of candidate windows from rows of doc_id, text, and lists of first windows and their numbers."""
    rows = repeats.Rows(merge=True, checked=True)
    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            part = batch.slice(start, stop - start)
            body, offsets = frames.raw(part.column(1))
            begins, ends, bounds = word_spans(body, offsets)
            joined, place = joined_words(body, begins, ends)
            owner = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.column(2).offsets, dtype=np.int64)))
            at, n = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            first = np.repeat(at + bounds[owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(owner, n)
            view, sha = memoryview(joined), hashlib.sha256
            names = b"".join([sha(view[a:b]).digest()[:16] for a, b in zip(place[first].tolist(), place[first + window].tolist())])
            halves = np.frombuffer(names, dtype="<u8").reshape(-1, 2)
            rows.add(halves[:, 0].copy(), part.column(0).to_numpy()[owner], first - bounds[owner], np.ones(len(first), np.int32), halves[:, 1].copy())
        yield from rows.out(False)
    yield from rows.out(True)


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed, the kept words joined by spaces, and the text, from rows of doc_id, text and repeated windows (null: none)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.large_binary()), ("text", pa.string())])
    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            part = batch.slice(start, stop - start)
            body, offsets = frames.raw(part.column(1))
            begins, ends, bounds = word_spans(body, offsets)
            gone = np.zeros(len(begins), dtype=bool)
            for k, at in enumerate(part.column(2)):
                if at.is_valid and len(at):
                    first = at.values.to_numpy()
                    gone[bounds[k] : bounds[k + 1]] = repeats.covered(first, first + part.column(3)[k].values.to_numpy() - 1 + window, bounds[k + 1] - bounds[k])
            joined, total = joined_words(body, begins, ends, ~gone)
            cuts = total[bounds]
            n_words, removed = np.diff(bounds), np.add.reduceat(np.append(gone, False), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
            removed = np.where(n_words > 0, removed, 0)
            view = memoryview(joined)
            kept = [bytes(view[a : max(a, b - 1)]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield frames.batch(schema, doc_id=part.column(0), n_words=n_words, n_removed=removed.astype(np.int64), kept=pa.array(kept, pa.large_binary()), text=part.column(1))


def _digests(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches, window):
        digest = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column(3).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], digest], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches, window):
        text = pc.if_else(pc.greater(batch.column(2), 0), batch.column(3).cast(pa.large_string()).cast(pa.string()), batch.column(4))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], text], names=["doc_id", "n_words", "n_removed", "text"])


def _marked(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """doc_id, text and the document's repeated windows: first words and numbers of windows that follow one another."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.filter("doc_id is not null").repartition(parts, "doc_id")  # the joins would put this filter below one use of the exchange
    candidates = repeats.by_document(repeats.repeated(docs.mapInArrow(lambda it: _anchors(it, window, rounds), repeats.DDL)), "at", "n")
    named = placed.join(candidates, "doc_id").select("doc_id", "text", "at", "n").mapInArrow(lambda it: _named(it, window), repeats.CHECKED_DDL)
    found = repeats.by_document(repeats.repeated(named), "at", "n")
    return placed.join(found, "doc_id", "left").select("doc_id", "text", "at", "n")


def removed_words(df: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    docs, restore = frames.unique_ids(frames.documents(df, id_col, text_col))
    return restore(_marked(docs, window, rounds).mapInArrow(lambda it: _digests(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def deduplicated(df: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and text of each row: the kept words joined by spaces, or the text as it was where nothing goes."""
    docs, restore = frames.unique_ids(frames.documents(df, id_col, text_col))
    return restore(_marked(docs, window, rounds).mapInArrow(lambda it: _texts(it, window), "doc_id long, n_words long, n_removed long, text string"))
