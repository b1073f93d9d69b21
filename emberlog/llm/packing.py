"""Order-preserving packing by dynamic programming (5).

Documents are tokenised in ascending id order, each with an end id, and the stream of ids is cut into sequences of at most `size` ids.
A cut costs nothing at a document's end, SENTENCE ids at a sentence's end and INSIDE ids elsewhere; a sequence costs its padding, which
is none at a power of two, and SEQUENCE for being one. Cuts come from the least total cost over windows of WINDOW ids:

    f(j) = cut(j) + SEQUENCE + min( min over j - size <= i < j of f(i) + i  + size - j,   min over powers of two p < size of f(j - p) )

The inner minimum is a sliding one, kept in a monotone queue, so a window takes time linear in its possible cuts. Sequences that end
well before a window's end are final; the rest moves on into the next window. The stream is range-partitioned by id into
spark.sql.shuffle.partitions parts, and a partition's last ids are cut into powers of two where that is cheaper than padding, so partitions
end without padding. Which sequences come out depends on where the parts begin, and so on that setting; the coverage of ids doesn't.

Null and empty texts are an end id alone. Very long documents go through several sequences. Rows with a null or repeated id are
documents in the order of (id, text). An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import chunks, frames

SIZE = 2048
SENTENCE, INSIDE, SEQUENCE = 8, 64, 16
WINDOW = 1 << 18
#: Longest stretch without a possible cut.
GAP = 64


def best_cuts(pos: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into pos of the sequences' ends, of least total cost; pos ascends from 0 and no two neighbours are over size apart."""
    n = len(pos)
    # candidates that a power of two leads to, in order of the later one
    later, earlier, p = [], [], 1
    while p < size:
        at = np.searchsorted(pos, pos - p)
        hit = np.flatnonzero((pos >= p) & (pos[at] == pos - p))
        later.append(hit)
        earlier.append(at[hit])
        p *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    numbers = lambda x: array("q", np.ascontiguousarray(x, dtype=np.int64).tobytes())  # noqa: E731  no object for each number
    firsts, earlier = numbers(np.searchsorted(later[order], np.arange(n + 1))), numbers(earlier[order])
    where, price = numbers(pos), numbers(cost + SEQUENCE)
    f, back = numbers(np.zeros(n)), numbers(np.zeros(n))
    queue, values, head = [0], [0], 0
    for j in range(1, n):
        x = where[j]
        while where[queue[head]] < x - size:
            head += 1
        best, via = values[head] + size - x, queue[head]
        for k in range(firsts[j], firsts[j + 1]):
            i = earlier[k]
            if f[i] < best:
                best, via = f[i], i
        best += price[j]
        f[j], back[j] = best, via
        v = best + x
        while len(values) > head and values[-1] >= v:
            values.pop()
            queue.pop()
        values.append(v)
        queue.append(j)
    out = [n - 1]
    while back[out[-1]]:
        out.append(back[out[-1]])
    return out[::-1]


class Packer:
    """Cuts a stream of documents; rows() gives the pieces of the sequences that are final."""

    def __init__(self, size: int = SIZE):
        self.size, self.docs, self.held, self.sequence = size, [], 0, 0
        self.out: list[tuple] = []

    def add(self, doc_id: int, ids: np.ndarray, cuts: np.ndarray) -> None:
        """cuts: the numbers of the document's ids before each of its sentence ends."""
        self.docs.append([doc_id, ids, cuts, 0])
        self.held += len(ids)
        if self.held >= WINDOW:
            self.solve(False)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        base, pos, cost = 0, [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for _, ids, cuts, start in self.docs:
            n = len(ids) - start
            inner = cuts[(cuts > start) & (cuts < len(ids))] - start
            pos += [inner + base, np.array([base + n])]
            cost += [np.full(len(inner), SENTENCE), np.zeros(1, np.int64)]
            base += n
        pos, cost = np.concatenate(pos), np.concatenate(cost)
        gap = np.diff(pos)
        more = np.maximum(0, (gap - 1) // GAP)
        if more.any():
            firsts = np.repeat(pos[:-1], more)
            steps = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
            pos, cost = np.concatenate([pos, firsts + steps * GAP]), np.concatenate([cost, np.full(len(steps), INSIDE)])
            order = np.argsort(pos, kind="stable")
            pos, cost = pos[order], cost[order]
        return pos, cost

    def solve(self, final: bool) -> None:
        if not self.held:
            return
        pos, cost = self.candidates()
        ends = [int(pos[k]) for k in best_cuts(pos, cost, self.size)]
        if final:
            start = ends[-2] if len(ends) > 1 else 0
            left, powers = ends[-1] - start, []
            while left:
                powers.append(1 << (left.bit_length() - 1))
                left -= powers[-1]
            if (len(powers) - 1) * (INSIDE + SEQUENCE) < self.size - (ends[-1] - start):
                ends[-1:] = (start + np.cumsum(powers)).tolist()
        else:
            ends = [x for x in ends if x <= pos[-1] - 4 * self.size] or ends[:1]
        self.emit(ends)

    def emit(self, ends: list[int]) -> None:
        done, k = 0, 0
        for end in ends:
            offset = 0
            while done < end:
                doc = self.docs[k]
                n = min(end - done, len(doc[1]) - doc[3])
                self.out.append((doc[0], doc[3], n, zlib.crc32(doc[1][doc[3] : doc[3] + n].tobytes()), len(doc[1]), self.sequence, offset))
                doc[3] += n
                done += n
                offset += n
                k += doc[3] == len(doc[1])
            self.sequence += 1
        self.docs, self.held = self.docs[k:], self.held - done

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "__row", "offset")] + [("__part", pa.int32())])
    part = TaskContext.get().partitionId()
    tokens, packer = chunks.word_ids(vocabulary), Packer(size)

    def out() -> Iterator[pa.RecordBatch]:
        if rows := packer.rows():
            columns = np.array(rows, dtype=np.int64).T
            yield frames.batch(schema, **dict(zip(schema.names, columns)), __part=np.full(len(rows), part, np.int32))

    for batch in chunks.groups(batches):
        ids, offsets, words, per_text, word_ends = tokens(batch.column(1), end)
        body, ends = frames.raw(words)
        last = np.zeros(len(words), dtype=np.uint8)
        some = ends[1:] > ends[:-1]
        last[some] = body[ends[1:][some] - 1]
        sentence = np.flatnonzero((last == ord(".")) | (last == ord("!")) | (last == ord("?")))
        bounds = np.searchsorted(sentence, per_text)
        stops = word_ends[sentence]
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            packer.add(doc_id, ids[offsets[k] : offsets[k + 1]].copy(), np.unique(stops[bounds[k] : bounds[k + 1]] - offsets[k]))
        yield from out()
    packer.solve(True)
    yield from out()


def pack(df: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset; sequences are numbered from 0 in id order."""
    docs, restore = frames.unique_ids(frames.documents(df, id_col, text_col))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    found = ranged.mapInArrow(lambda it: _pieces(it, vocabulary, end, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, __row long, offset long, __part int")
    numbered = frames.with_bases(frames.staged(found, "pieces"), "__part", "__row", "sequence_id")
    return restore(numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))


def sequences(df: DataFrame, pieces: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, size: int = SIZE, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id and its ids (padded to size, but at a power of two), built from the documents and their pieces; ids of df must be unique."""
    docs = frames.documents(df, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunks.word_ids(vocabulary)
        for batch in chunks.groups(batches):
            ids, offsets, *_ = tokens(batch.column(1), end)
            yield frames.batch(schema, doc_id=batch.column(0), ids=pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int64))))

    encoded = docs.mapInArrow(run, "doc_id long, ids array<long>")
    cut = pieces.join(encoded, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start") + 1, F.col("length")).alias("ids"))
    whole = cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    full = F.bit_count(n) == 1
    return whole.select("sequence_id", F.when(full, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), F.lit(size) - n))).alias("ids"))
