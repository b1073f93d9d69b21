"""N-gram Jaccard join by vertical partitioning (6): documents whose sets of word shingles are alike, as components of links.

Two documents link when 100 * |A & B| >= percent * |A | B|. The global order of the shingles is that of their names, cut into F
fragments, so each document's set is cut into segments. Links are found in five steps.

1. Documents with one word sequence (by its SHA-256) are a class; only its smallest document goes on.
2. Linked sets differ in k elements at most, which lie in k fragments at most. F is 1.5 (k + 1) or more, so linked documents have many
   equal segments, at least (their segments - k). F and k belong to a level of set sizes; a document takes part at its own level and at
   the levels of the smaller partners that it may have. Where many of its segments are empty, it takes part with more fragments too.
   Segments that occur once are dropped, then documents with too few others at a level, then again.
3. What remains are near copies. Documents that share segments, over some others, are a cluster, so all links lie within clusters. Each
   document has one edge for each of its segments at most, however large the cluster is.
4. Each cluster's head is the document with the most popular segments. The partial overlaps of each document with its head are counted
   for each of PARTS fragments apart and summed per pair. Documents that link with the head are one component and need no other pair among
   them.
5. The others can only add links between themselves, and with those documents that the triangle inequality over the head doesn't rule
   out. Those pairs meet in blocks of about BLOCK documents, where partial overlaps are again counted fragment by fragment; a task gives a
   spanning forest of what it connects. The blocks of a large cluster hold sets of one band of sizes and meet those of bands next to theirs,
   as linked sets have alike sizes. What is sent still grows with the square of a band, so it is sent in rounds of at most the size of all
   sets, each of which is off the disk before the next.

A shingle's name has 128 bits, in two lanes of a keyed hash; overlaps are counted in both. No candidate is capped. Null and empty texts,
and texts without words, have empty sets and link with nothing. Very long texts are handled whole. Rows with a null or repeated id are
documents of their own in the order of (id, text). An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import components, frames
from emberlog.llm.words import joined_words, lower_ascii, mix, owners, prefix_hash, span_hash, word_hashes, word_spans

GRAM, PERCENT = 4, 85
#: Ratio of the sizes of a level.
RATIO = 1.384
#: Fragments for each element in which linked sets may differ.
SLACK = 1.5
#: Documents of a block, and shingles of a block.
BLOCK, BLOCK_SHINGLES = 400, 1 << 20
#: Shingles that a round of step 5 may send in any case.
ROUND_SHINGLES = 1 << 22
#: Fragments whose partial overlaps steps 4 and 5 count apart.
PARTS = 8

_HALF = np.uint64(32)


def shingle_sets(texts: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First lanes of the sorted distinct shingles of each text, one after another, and the n + 1 offsets of the texts."""
    (hashes,), bounds = shingle_names(texts, gram, 1)
    return hashes, bounds


def shingle_names(texts: pa.Array, gram: int, lanes: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Lanes of the sorted distinct shingles of each text, and the n + 1 offsets of the texts."""
    body, offsets = frames.raw(texts)
    starts, ends, bounds = word_spans(body, offsets)
    count = np.diff(bounds)
    shingles = np.where(count >= gram, count - gram + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), shingles)
    first = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles) + bounds[owner]
    last = first + np.minimum(count[owner], gram)
    low = lower_ascii(body)
    names = [span_hash(prefix_hash(word_hashes(low, starts, ends, lane)), first, last) for lane in range(lanes)]
    order = np.lexsort((*names[::-1], owner))
    names, owner = [x[order] for x in names], owner[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = owner[1:] != owner[:-1]
    for x in names:
        new[1:] |= x[1:] != x[:-1]
    owner = owner[new]
    return [x[new] for x in names], np.searchsorted(owner, np.arange(len(count) + 1))


def differing(size: int | np.ndarray, percent: int):
    """Most elements in which a set of a size and a linked one that isn't smaller differ."""
    return (100 - percent) * (100 * size // percent) // 100


class Levels:
    """Ranges of set sizes, and the fragments of each."""

    def __init__(self, percent: int):
        self.percent, self.firsts = percent, [1]

    def start(self, level: int) -> int:
        while len(self.firsts) <= level:
            self.firsts.append(max(self.firsts[-1] + 1, int(np.ceil(self.firsts[-1] * RATIO))))
        return self.firsts[level]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        level = 0
        while self.start(level) <= int(sizes.max(initial=1)):
            level += 1
        return np.searchsorted(np.array(self.firsts), sizes, side="right") - 1

    def most(self, level: int) -> int:
        """Elements in which linked sets differ at most, the smaller one being of this level."""
        return int(differing(self.start(level + 1) - 1, self.percent))

    def fragments(self, level: int, scheme: int) -> int:
        """More with each scheme; where no two sets may differ, one is enough for all."""
        k = self.most(level)
        return 1 if k == 0 else int(np.ceil(SLACK * (k + 1))) << (2 * scheme)


def segment_keys(hashes: np.ndarray, bounds: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the documents' segments: key, document, level and scheme in one number, and how many equal segments a link needs there."""
    size = np.diff(bounds)
    own = levels.of(size)
    lowest = levels.of(np.maximum(1, -(-size * levels.percent // 100)))  # of the smallest linked partner
    values = mix(hashes)
    out = []
    for level in range(int(own.max(initial=-1)) + 1):
        open_ = np.flatnonzero((size > 0) & (lowest <= level) & (level <= own))
        k = levels.most(level)
        for scheme in range(64):
            if not len(open_):
                break
            n = levels.fragments(level, scheme)
            counts = size[open_]
            owner = np.repeat(np.arange(len(open_)), counts)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[open_], counts)
            fragment = ((hashes[place] >> _HALF) * np.uint64(n) >> _HALF).astype(np.int64)
            new = np.ones(len(place), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])
            at = np.flatnonzero(new)
            total = np.add.reduceat(values[place], at)
            kind = level * 64 + scheme
            key = mix(total + mix(fragment[at].astype(np.uint64) + mix(np.full(len(at), kind, dtype=np.uint64))))
            segments = np.bincount(owner[at], minlength=len(open_))
            # the sets' own difference is bounded by the size too
            need = np.maximum(1, segments - np.minimum(k, differing(np.where(own[open_] == level, counts, np.minimum(counts, levels.start(level + 1) - 1)), levels.percent)))
            out.append((key, open_[owner[at]], np.full(len(at), kind), need[owner[at]]))
            open_ = open_[segments < k + 1]  # too many empty segments for k differences to leave one that isn't
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _fingerprints(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """doc_id, the size of its set, and the SHA-256 of its words joined by spaces."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("name", pa.binary())])
    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            texts = batch.column(1).slice(start, stop - start)
            _, bounds = shingle_sets(texts, gram)
            body, offsets = frames.raw(texts)
            begins, ends, words = word_spans(body, offsets)
            joined, total = joined_words(lower_ascii(body), begins, ends)
            view, cuts = memoryview(joined), total[words].tolist()
            names = [hashlib.sha256(view[a:b]).digest() for a, b in zip(cuts[:-1], cuts[1:])]
            yield frames.batch(schema, doc_id=batch.column(0).slice(start, stop - start), n=np.diff(bounds), name=pa.array(names, pa.binary()))


SEGMENTS = pa.schema([("key", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32()), ("need", pa.int32())])


def _segments(batches: Iterator[pa.RecordBatch], gram: int, percent: int, limit: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Segments of all documents. Those that occur twice in the task are shared whatever the others hold: they travel under keys of their
    own, with the segment beside, and one row without a document speaks for the segment."""
    levels, held, size = Levels(percent), [], 0

    def out() -> Iterator[pa.RecordBatch]:
        key, doc, kind, need = (np.concatenate(x) for x in zip(*held))
        key = key.view(np.int64)
        kind, need = kind.astype(np.int32), need.astype(np.int32)
        order = np.argsort(key, kind="stable")
        by_key = key[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = by_key[1:] != by_key[:-1]
        single = first.copy()
        single[:-1] &= first[1:]
        alone = np.empty(len(key), dtype=bool)  # rows stay in the order of documents, which packs better
        alone[order] = single
        shown = np.where(alone, key, mix(mix(doc.view(np.uint64)) + key.view(np.uint64)).view(np.int64))
        for a in range(0, len(key), 200_000):
            s = slice(a, a + 200_000)
            yield frames.batch(SEGMENTS, key=shown[s], segment=pa.array(key[s], pa.int64(), mask=alone[s]), doc_id=doc[s], kind=kind[s], need=need[s])
        speak = by_key[first & ~single]
        if len(speak):
            none, zero = pa.nulls(len(speak), pa.int64()), np.zeros(len(speak), np.int32)
            yield frames.batch(SEGMENTS, key=speak, segment=none, doc_id=none, kind=zero, need=zero)

    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            hashes, bounds = shingle_sets(batch.column(1).slice(start, stop - start), gram)
            key, doc, kind, need = segment_keys(hashes, bounds, levels)
            held.append((key, batch.column(0).slice(start, stop - start).to_numpy()[doc], kind, need))
            size += len(key)
            if size >= limit:
                yield from out()
                held, size = [], 0
    if size:
        yield from out()


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose segment more than one row has."""
    often = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("segment")
    return rows.join(often, "segment", "left_semi")


def _pruned(rows: DataFrame) -> DataFrame:
    """Shared rows of documents that have enough of them at their level."""
    enough = rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("__n"), F.max("need").alias("__need")).filter("__n >= __need").select("doc_id", "kind")
    return rows.join(enough, ["doc_id", "kind"], "left_semi")


SETS_DDL = "doc_id long, cluster long, n long, first array<array<long>>, second array<array<long>>"
_NESTED = pa.list_(pa.list_(pa.int64()))


def _sets(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """doc_id, cluster, size of the set, and both lanes of its shingles in PARTS fragments of the global order, from rows of doc_id, text, cluster."""
    schema = pa.schema([("doc_id", pa.int64()), ("cluster", pa.int64()), ("n", pa.int64()), ("first", _NESTED), ("second", _NESTED)])
    for batch in batches:
        for start, stop in frames.pieces(batch.column(1)):
            part = batch.slice(start, stop - start)
            lanes, bounds = shingle_names(part.column(1), gram)
            fragment = (lanes[0] >> _HALF) * np.uint64(PARTS) >> _HALF
            cuts = np.searchsorted(owners(bounds) * PARTS + fragment.astype(np.int64), np.arange(len(part) * PARTS + 1))
            outer = pa.array(np.arange(len(part) + 1, dtype=np.int32) * PARTS)
            nested = [pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.view(np.int64)))) for x in lanes]
            yield frames.batch(schema, doc_id=part.column(0), cluster=part.column(2), n=np.diff(bounds), first=nested[0], second=nested[1])


def overlaps(lanes: list[np.ndarray], cuts: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Common elements of each pair of sets, which lie one after another, each cut into parts: partial overlaps of each part, summed."""
    n = (len(cuts) - 1) // parts
    total = np.zeros((n, n), dtype=np.float32)
    owner = owners(cuts)
    for f in range(parts):
        own = np.flatnonzero(owner % parts == f)
        order = own[np.lexsort([x[own] for x in lanes[::-1]])]
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = False
        for x in lanes:
            new[1:] |= x[order][1:] != x[order][:-1]
        column = np.cumsum(new) - 1
        often = np.bincount(column) > 1 if len(order) else np.zeros(0, dtype=bool)
        rank, keep = np.cumsum(often) - 1, often[column]
        rows, columns = owner[order][keep] // parts, rank[column[keep]]
        width = int(often.sum())
        for start in range(0, width, 8192):  # columns at a time, for the matrix to stay small
            s = (columns >= start) & (columns < start + 8192)
            matrix = np.zeros((n, min(8192, width - start)), dtype=np.float32)
            matrix[rows[s], columns[s] - start] = 1
            total += matrix @ matrix.T
    return np.rint(total).astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the edges (a, b) connect, as few as possible."""
    parent = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = x, y
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        while parent[q] != q:
            parent[q] = parent[parent[q]]
            q = parent[q]
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(table: pa.Table, percent: int) -> pa.Table:
    """Edges that connect the components (label) of which documents of a pair of blocks link; rows of doc_id, label, n, first, second."""
    table = table.combine_chunks()
    flat = [table.column(c).chunk(0).flatten() if table.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("first", "second")]
    cuts = np.asarray(flat[0].offsets, dtype=np.int64) if table.num_rows else np.zeros(1, np.int64)
    common = overlaps([x.flatten().to_numpy().view(np.uint64) for x in flat], cuts - cuts[0])
    size, label = table.column("n").to_numpy(), table.column("label").to_numpy()
    union = size[:, None] + size[None, :] - common
    a, b = np.nonzero(np.triu((100 * common >= percent * union) & (common > 0) & (label[:, None] != label[None, :]), 1))
    names, codes = np.unique(label, return_inverse=True)
    chosen = np.array(forest(codes[a], codes[b], len(names)), dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(names[chosen[:, 0]], pa.int64()), "b": pa.array(names[chosen[:, 1]], pa.int64())}, schema=EDGES)


def classes(df: DataFrame, gram: int = GRAM) -> DataFrame:
    """doc_id, n (set size) and representative (smallest document with the same words; itself where there are none) of docs (doc_id, text)."""
    prints = frames.staged(df.mapInArrow(lambda it: _fingerprints(it, gram), "doc_id long, n long, name binary"), "fingerprints")
    heads = prints.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("representative"))
    heads = frames.staged(heads, "heads")  # both sides of the join then come from exchanges, whose skewed partitions are split
    found = prints.join(heads, "name", "left")
    return found.select("doc_id", "n", F.coalesce("representative", "doc_id").alias("representative"))


def clusters(docs: DataFrame, heads: DataFrame, gram: int, percent: int) -> DataFrame:
    """doc_id, cluster and weight (how often its shared segments occur) of the near copies among heads (doc_id) of docs (doc_id, text)."""
    made = docs.mapInArrow(lambda it: _segments(it, gram, percent), "key long, segment long, doc_id long, kind int, need int")
    often = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = made.withColumn("__n", often).filter("doc_id is not null and (segment is not null or __n > 1)")
    shared = shared.select(F.coalesce("segment", "key").alias("segment"), "doc_id", "kind", "need")
    rows = frames.staged(shared.join(heads, "doc_id", "left_semi"), "segments")
    for _ in range(2):
        wider, rows = rows, frames.staged(_pruned(_shared(rows)), "segments")
        frames.dropped(wider)
    often = frames.staged(rows.groupBy("segment").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("often")).filter("often > 1"), "leaders")
    led = rows.join(often, "segment").groupBy("doc_id", "leader").agg(F.sum("often").alias("weight"))
    led = frames.staged(led, "led")  # a document and one leader of its segments
    label = components.components(led.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
    weight = led.groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    return weight.join(label, weight["doc_id"] == label["node"]).select("doc_id", F.col("label").alias("cluster"), "weight")


def links(docs: DataFrame, heads: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect the linked documents among heads (doc_id) of docs (doc_id, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    member = frames.settled(lambda: clusters(docs, heads, gram, percent), "clusters")
    made = docs.join(member, "doc_id").select("doc_id", "text", "cluster").mapInArrow(lambda it: _sets(it, gram), SETS_DDL)
    sets = frames.staged(made, "sets")
    # step 4: partial overlaps with the cluster's head, fragment by fragment
    head = member.groupBy("cluster").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("doc_id"))
    heads_sets = frames.staged(sets.join(head, ["cluster", "doc_id"], "left_semi"), "head_sets")
    fragments = lambda df: df.select("cluster", "doc_id", "n", F.posexplode(F.arrays_zip("first", "second")).alias("fragment", "part")).select("cluster", "doc_id", "n", "fragment", "part.first", "part.second")
    left, right = fragments(sets), fragments(heads_sets).select("cluster", "fragment", F.col("doc_id").alias("head"), F.col("n").alias("head_n"), F.col("first").alias("head_first"), F.col("second").alias("head_second"))
    partial = F.least(F.size(F.array_intersect("first", "head_first")), F.size(F.array_intersect("second", "head_second")))
    pairs = left.join(right, ["cluster", "fragment"]).select("cluster", "doc_id", "n", "head", "head_n", partial.alias("common"))
    summed = pairs.groupBy("cluster", "doc_id", "n", "head", "head_n").agg(F.sum("common").alias("common"))
    union = F.col("n") + F.col("head_n") - F.col("common")
    near = frames.staged(summed.select("cluster", "doc_id", "n", "head", (100 * F.col("common") >= percent * union).alias("linked"), (union - F.col("common")).alias("distance")), "near")
    # step 5: linked sets differ in (100 - percent) / (100 + percent) of their sizes at most, and distances to the head as much at most;
    # times 100 + percent all is in whole numbers
    span, away = (100 - percent) * F.col("n"), (100 + percent) * F.col("distance")
    rest = near.filter(~F.col("linked")).groupBy("cluster").agg(F.count(F.lit(1)).alias("rest"), F.sum("n").alias("rest_n"), F.min(away - span).alias("nearest"))
    met = near.join(rest, "cluster").filter(~F.col("linked") | (away + span >= F.col("nearest")))
    sizes = met.groupBy("cluster").agg(((F.count(F.lit(1)) > BLOCK) | (F.sum("n") > BLOCK_SHINGLES)).alias("large"))
    met = met.select("doc_id", "cluster", "n", "linked", F.when(F.col("linked"), F.col("head")).otherwise(F.col("doc_id")).alias("label")).join(sizes, "cluster")
    # linked sets are in one band or in bands next to each other; the last factor is far above a logarithm's error
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent * (1 + 1e-9))))
    met = frames.staged(met.withColumn("band", F.when(F.col("large"), band).otherwise(F.lit(0))), "met")
    blocks = lambda count, size: F.greatest(F.ceil(count / BLOCK), F.ceil(size / BLOCK_SHINGLES))
    of = lambda which: blocks(F.count_if(which), F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)))
    # documents of a cluster that isn't large are one block, whether they link with the head or not
    filled = frames.staged(met.groupBy("cluster", "band").agg(of(~F.col("linked") | ~F.col("large")).alias("rest_blocks"), of(F.col("linked") & F.col("large")).alias("linked_blocks")), "filled")
    beside = F.explode(F.array(*[F.struct((F.col("band") + k).alias("band"), F.lit(-k).alias("step"), "rest_blocks", "linked_blocks") for k in (-1, 0, 1)])).alias("x")
    beside = filled.select("cluster", beside).select("cluster", "x.*").groupBy("cluster", "band").agg(F.collect_list(F.struct("step", "rest_blocks", "linked_blocks")).alias("beside"))
    count = F.aggregate("beside", F.lit(0).cast("long"), lambda n, x: n + x["rest_blocks"] + F.when(F.col("apart"), F.lit(0)).otherwise(x["linked_blocks"]))
    own = F.aggregate("beside", F.lit(0).cast("long"), lambda n, x: n + F.when(x["step"] == 0, F.when(F.col("apart"), x["linked_blocks"]).otherwise(x["rest_blocks"])).otherwise(F.lit(0)))
    met = met.join(beside, ["cluster", "band"]).withColumn("apart", F.col("linked") & F.col("large")).withColumn("copies", count).withColumn("own", F.pmod(F.xxhash64("doc_id"), own))
    carried = frames.staged(sets.select("doc_id", "first", "second").join(met, "doc_id").drop("large", "linked"), "carried")
    volume, room = carried.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0, sets.agg(F.sum("n")).first()[0] or 0
    frames.dropped(sets, heads_sets)
    name = lambda band, apart, number: F.struct(band.alias("band"), apart.alias("apart"), number.cast("long").alias("number"))
    numbers = lambda n, band, apart: F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")), lambda k: name(band, F.lit(apart), k))
    others = F.flatten(F.transform("beside", lambda x: F.concat(numbers(x["rest_blocks"], F.col("band") + x["step"], False), F.when(F.col("apart"), F.array().cast("array<struct<band:long,apart:boolean,number:long>>")).otherwise(numbers(x["linked_blocks"], F.col("band") + x["step"], True)))))
    dealt = carried.withColumn("other", F.explode(others)).withColumn("mine", name(F.col("band"), F.col("apart"), F.col("own")))
    dealt = dealt.select("cluster", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "doc_id", "label", "n", "first", "second")
    columns = ["doc_id", "label", "n", "first", "second"]
    # pairs of blocks come in rounds, none of which sends more than all sets are, however large a cluster is
    rounds, found = max(1, math.ceil(volume / max(room, ROUND_SHINGLES))), near.filter("linked and doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    for k in range(rounds):
        some = dealt.filter(F.pmod(F.xxhash64(F.lit(7), "cluster", "one", "two"), F.lit(rounds)) == k) if rounds > 1 else dealt
        edges = some.repartition(parts, "cluster", "one", "two").groupBy("cluster", "one", "two").applyInArrow(lambda table: _links(table.select(columns), percent), "a long, b long")
        found = found.unionByName(frames.staged(edges, "round") if rounds > 1 else edges)
    return found


def near_components(df: DataFrame, gram: int = GRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest document that links reach, itself included) of each row."""
    docs, restore = frames.unique_ids(frames.documents(df, id_col, text_col))

    def found() -> DataFrame:
        known = frames.settled(lambda: classes(docs, gram), "classes")
        heads = known.filter("n > 0 and doc_id = representative").select("doc_id")
        edges = frames.settled(lambda: links(docs, heads, gram, percent), "links")
        label = components.components(edges).select(F.col("node").alias("representative"), F.col("label"))
        return known.join(label, "representative", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "representative").alias("component_id"))

    return restore(frames.settled(found, "found"))
