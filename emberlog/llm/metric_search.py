"""Exact top-k search by inner product with M-trees (4).

Vectors become integers, floor(scale * x). Each goes to the cell of its nearest pivot; pivots are a bounded sample of the rows, so cells are
a few balls whose centres, radii and largest norms every task can hold. A cell is dealt by id to shards of about SHARD vectors, and each
shard's M-tree is bulk-loaded into pages, which are rows of an index table.

Queries are routed in two rounds. The first visits one shard of the cell with the best bound and gives each query its k-th best score so
far. The second takes that score along to every shard whose cell can still hold as good a product, and to no other. In each round a shard's
pages go once to the task that reads them before its queries stream by; a shard that more than QUERIES queries visit goes to as many tasks
as that takes. So the index is shipped as often as the queries that need it demand, and not once for each block of all queries.

A query visits a shard's pages best first, by the largest inner product that a page can hold: q.x <= q.c + |q| r in a ball around c. With
D = d(q, pivot) known, an entry at distance p from the pivot is at least |D - p| from q, so q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 is bounded
without a look at the entry's vector; its product is computed only where that bound reaches the k-th best score so far. The search ends
when no page can. Ties go to the smaller id, and bounds that equal the k-th best score are followed, so results are exact.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors of different lengths are not
compared. A query's own id is no candidate of it. Of repeated ids every row is a candidate and the smallest vector is the query. With
fewer candidates than k all are returned. An empty table gives an empty result. Components must stay within 2**31 / length after
scaling, for scores to be 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import frames

K, SCALE = 10, 1024
SHARD, PAGE = 8192, 64
#: Pivots at most; each is a row of the input that a hash of its id picks.
PIVOTS = 1024
#: Queries that one copy of a shard serves.
QUERIES = 2048

_LISTS = [("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.int64())), ("children", pa.list_(pa.int32())), ("parents", pa.list_(pa.float64())), ("radii", pa.list_(pa.float64())), ("norms", pa.list_(pa.float64()))]
PAGES = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int32()), ("page", pa.int32()), *_LISTS])
PAGES_DDL = "dim int, cell int, shard int, page int, ids array<long>, vectors array<long>, children array<int>, parents array<double>, radii array<double>, norms array<double>"
HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Page:
    """Entries of a node: ids of vectors, or children with radii; all with vectors, distances to the pivot above and norms."""

    __slots__ = ("ids", "vectors", "children", "parents", "radii", "norms")

    def __init__(self, ids, vectors, children, parents, radii, norms):
        self.ids, self.vectors, self.children, self.parents, self.radii, self.norms = ids, vectors, children, parents, radii, norms


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def build(ids: np.ndarray, vectors: np.ndarray) -> list[Page]:
    """Pages of an M-tree over vectors; page 0 is the root, whose entries have no pivot above (distance nan)."""
    pages: list[Page | None] = [None]
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    todo = [(0, np.arange(len(ids)), None)]
    while todo:
        number, own, pivot = todo.pop()
        above = np.full(len(own), np.nan) if pivot is None else distances(vectors[own], vectors[pivot : pivot + 1])[:, 0]
        if len(own) <= PAGE:
            pages[number] = Page(ids[own], vectors[own], np.zeros(0, np.int32), above, np.zeros(0), norms[own])
            continue
        want = min(PAGE, -(-len(own) // PAGE))
        chosen = [int(np.argmax(norms[own]))]  # pivots far from each other
        near = distances(vectors[own], vectors[own[chosen[0]]][None, :])[:, 0]
        which = np.zeros(len(own), dtype=np.int64)
        while len(chosen) < want:
            far = int(np.argmax(near))
            if near[far] == 0:
                break
            d = distances(vectors[own], vectors[own[far]][None, :])[:, 0]
            closer = d < near
            near[closer], which[closer] = d[closer], len(chosen)
            chosen.append(far)
        if len(chosen) == 1:  # all vectors are equal: any split does
            which = np.arange(len(own)) * want // len(own)
            chosen = np.unique(which, return_index=True)[1].tolist()
        pivots = own[np.array(chosen)]
        children = np.arange(len(pages), len(pages) + len(pivots), dtype=np.int32)
        pages += [None] * len(pivots)
        radii, most = np.zeros(len(pivots)), np.zeros(len(pivots))
        for k in range(len(pivots)):
            part = own[which == k]
            radii[k], most[k] = near[which == k].max(initial=0), norms[part].max(initial=0)
            todo.append((int(children[k]), part, int(pivots[k])))
        to_pivot = np.full(len(pivots), np.nan) if pivot is None else distances(vectors[pivots], vectors[pivot : pivot + 1])[:, 0]
        pages[number] = Page(ids[pivots], vectors[pivots], children, to_pivot, radii, most)
    return pages


def search(pages: list[Page], query_id: int, query: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
    """(score, id) of the k best entries, best first; of those below least only some."""
    q2 = float((query.astype(np.float64) ** 2).sum())
    norm = q2**0.5
    slack = 1e-9 * (q2 + 1) + 1e-6
    best: list[tuple[int, int]] = []  # heap of (score, -id)
    queue = [(-np.inf, 0, np.nan)]
    while queue:
        bound, number, to_pivot = heapq.heappop(queue)
        floor = max(least, best[0][0]) if len(best) == k else least
        if -bound < floor:
            break
        page = pages[number]
        leaf = not len(page.children)
        if not len(page.ids):
            continue
        if to_pivot == to_pivot:
            gap = np.abs(to_pivot - page.parents)
            gap = gap if leaf else np.maximum(0, gap - page.radii)
            room = 2 * slack + 1e-6 * page.norms * (norm + page.norms)
            may = np.flatnonzero((q2 + page.norms**2 - gap**2) / 2 + room >= floor)
        else:
            may = np.arange(len(page.ids))
        if not len(may):
            continue
        products = page.vectors[may] @ query
        if leaf:
            ids = page.ids[may]
            for score, vec in zip(products.tolist(), ids.tolist()):
                if vec == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -vec))
                elif (score, -vec) > best[0]:
                    heapq.heapreplace(best, (score, -vec))
        else:
            vectors = page.vectors[may].astype(np.float64)
            to_child = np.sqrt(np.maximum(q2 + (vectors * vectors).sum(axis=1) - 2 * products, 0))
            radii, most = page.radii[may], page.norms[may]
            inside = np.minimum(products + norm * radii, np.minimum(norm * most, (q2 + most**2 - np.maximum(0, to_child - radii) ** 2) / 2))
            inside = inside + 2 * slack + 1e-6 * most * (norm + most)
            for b, child, d in zip(inside.tolist(), page.children[may].tolist(), to_child.tolist()):
                if b >= floor:
                    heapq.heappush(queue, (-b, child, d))
    return [(s, -v) for s, v in sorted(best, key=lambda x: (-x[0], -x[1]))]


def integers(column: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector has no part."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _build(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    place = [table.column(c)[0].as_py() for c in ("dim", "cell", "shard")]
    order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
    vectors = table.column("vector").chunk(0).flatten().to_numpy().reshape(table.num_rows, place[0])[order]
    pages = build(table.column("vec_id").to_numpy()[order], vectors)
    columns = [[getattr(p, n).ravel() for p in pages] for n in ("ids", "vectors", "children", "parents", "radii", "norms")]
    return pa.table([*(pa.array([x] * len(pages), pa.int32()) for x in place), pa.array(range(len(pages)), pa.int32()), *(pa.array(c, f[1]) for c, f in zip(columns, _LISTS))], schema=PAGES)


class Cells:
    """Balls around pivots by vector length: which is nearest to a vector, and how large a product with a vector in each can be."""

    def __init__(self, pivots: dict[int, np.ndarray]):
        self.pivots = pivots

    def nearest(self, dim: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot; cell -1, where no pivot has that length."""
        if dim not in self.pivots:
            return np.full(len(vectors), -1), np.zeros(len(vectors))
        d = distances(vectors, self.pivots[dim])
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(cell)), cell]

    def bounds(self, dim: int, queries: np.ndarray, cells: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
        q = queries.astype(np.float64)
        norm = np.sqrt((q * q).sum(axis=1))[:, None]
        out = np.repeat(norm * norms[None, :], 1, axis=0)
        known = cells >= 0
        if known.any():
            pivots = self.pivots[dim][cells[known]].astype(np.float64)
            products = q @ pivots.T
            away = np.maximum(0, distances(queries, pivots) - radii[known])
            most = norms[known][None, :]
            out[:, known] = np.minimum(out[:, known], np.minimum(products + norm * radii[known], (norm**2 + most**2 - away**2) / 2))
        return out + 2e-9 * (norm**2 + 1) + 2e-6 + 1e-6 * norms[None, :] * (norm + norms[None, :])


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of a batch (their first columns: dim, vector) of one length at a time, with their vectors as a matrix."""
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            yield dim, rows, rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _assigned(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("dim", pa.int32()), ("vector", pa.list_(pa.int64())), ("vec_id", pa.int64()), ("cell", pa.int32()), ("away", pa.float64()), ("norm", pa.float64())])
    for dim, rows, vectors in _by_length(batches):
        cell, away = cells.nearest(dim, vectors)
        yield frames.batch(schema, dim=rows.column(0), vector=rows.column(1), vec_id=rows.column(2), cell=cell, away=away, norm=np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)))


ROUTED = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("query_id", pa.int64()), ("vector", pa.list_(pa.int64())), ("least", pa.float64())])
ROUTED_DDL = "dim int, cell int, query_id long, vector array<long>, least double"


def _routed(batches: Iterator[pa.RecordBatch], cells: Cells, balls: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: bool) -> Iterator[pa.RecordBatch]:
    """Rows of dim, vector, query_id and least by the cells to visit: the one with the best bound, or all that can hold a product of least or more."""
    for dim, rows, vectors in _by_length(batches):
        numbers, radii, norms = balls[dim]
        bounds = cells.bounds(dim, vectors, numbers, radii, norms)
        least = rows.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        if first:
            row, at = np.arange(len(rows)), bounds.argmax(axis=1)
        else:
            row, at = np.nonzero(bounds >= least[:, None])
        for k in range(0, len(row), 4096):
            some = pa.array(row[k : k + 4096])
            yield frames.batch(ROUTED, dim=rows.column(0).take(some), cell=numbers[at[k : k + 4096]], query_id=rows.column(2).take(some), vector=rows.column(1).take(some), least=least[row[k : k + 4096]])


VISIT = ["dim", "cell", "shard", "copy", "page", *[name for name, _ in _LISTS], "query_id", "vector", "least"]


def _visited(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Hits of the queries of each shard; a shard's pages come before its queries."""
    key, raw, pages = None, [], []
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        rows = batch.to_pydict()
        lists = [batch.column(name) for name, _ in _LISTS]
        for at, (dim, *place) in enumerate(zip(rows["dim"], rows["cell"], rows["shard"], rows["copy"])):
            if key != (dim, *place):
                key, raw, pages = (dim, *place), [], []
            if rows["page"][at] is not None:
                raw.append([c[at].values.to_numpy(zero_copy_only=False) for c in lists])
                continue
            if raw:
                pages, raw = [Page(i, v.reshape(len(i), dim), *rest) for i, v, *rest in raw], []
            query_id = rows["query_id"][at]
            for score, vec in search(pages, query_id, np.array(rows["vector"][at], dtype=np.int64), k, rows["least"][at]):
                out[0].append(query_id)
                out[1].append(vec)
                out[2].append(score)
        yield frames.batch(HITS, query_id=out[0], vec_id=out[1], score=out[2])


def _visit(pages: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Hits of pairs (query and shard) over the pages of the shards, in the shared folder."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = ["dim", "cell", "shard"]
    pairs = frames.staged(pairs, "pairs")
    copies = pairs.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("copies"))
    left = pages.join(copies, shard).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    right = pairs.join(copies, shard).withColumn("copy", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int"))
    rows = left.drop("copies").unionByName(right.drop("copies"), allowMissingColumns=True).select(*VISIT)
    dealt = rows.repartition(parts, *shard, "copy").sortWithinPartitions(*shard, "copy", F.col("page").asc_nulls_last())
    return frames.staged(dealt.mapInArrow(lambda it: _visited(it, k), "query_id long, vec_id long, score long"), "hits")


class Index:
    """M-trees over vectors (vec_id, dim, vector): pages as a table, cells, and the number of shards of each cell."""

    def __init__(self, vectors: DataFrame):
        n = vectors.count()
        picked = vectors.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id", "vector").limit(max(1, min(PIVOTS, -(-n // SHARD)))).select("dim", "vector")
        pivots: dict[int, list] = {}
        for r in picked.toLocalIterator():  # PIVOTS at most
            pivots.setdefault(r["dim"], []).append(r["vector"])
        self.cells = cells = Cells({dim: np.unique(np.array(v, dtype=np.int64).reshape(len(v), dim), axis=0) for dim, v in pivots.items()})
        assigned = vectors.select("dim", "vector", "vec_id").mapInArrow(lambda it: _assigned(it, cells), "dim int, vector array<long>, vec_id long, cell int, away double, norm double")
        assigned = frames.staged(assigned, "assigned")
        sizes = assigned.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"), F.max("away").alias("radius"), F.max("norm").alias("norm"))
        found = sorted(tuple(r) for r in sizes.toLocalIterator())  # a row for each pivot, and for each length without one
        self.balls = {dim: tuple(np.array([r[c] for r in found if r[0] == dim]) for c in (1, 3, 4)) for dim in {r[0] for r in found}}
        self.sizes = vectors.sparkSession.createDataFrame([r[:3] for r in found], "dim int, cell int, shards int")
        dealt = assigned.join(F.broadcast(self.sizes), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
        self.pages = frames.staged(dealt.select("dim", "cell", "shard", "vec_id", "vector").groupBy("dim", "cell", "shard").applyInArrow(_build, PAGES_DDL), "mtree")

    def route(self, asked: DataFrame, first: bool) -> DataFrame:
        """Rows of asked (query_id, dim, vector, least) by the cells to visit, and their numbers of shards."""
        cells, balls = self.cells, self.balls
        to = asked.select("dim", "vector", "query_id", "least").mapInArrow(lambda it: _routed(it, cells, balls, first), ROUTED_DDL)
        return to.join(F.broadcast(self.sizes), ["dim", "cell"])


def nearest(df: DataFrame, queries: Column | None = None, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best of all rows by integer inner product, for each row that queries selects.

    queries: a condition on the columns vec_id and vector, by default vec_id divisible by 100.
    """
    vectors = df.select(F.col(frames.quoted(id_col)).cast("long").alias("vec_id"), integers(F.col(frames.quoted(vector_col)), scale).alias("vector")).filter("vec_id is not null and vector is not null").withColumn("dim", F.size("vector"))
    asked = vectors.filter(F.col("vec_id") % 100 == 0 if queries is None else queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    asked = frames.staged(asked, "queries")
    index = Index(vectors)
    best = lambda hits: hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    home = F.pmod(F.xxhash64("query_id"), F.col("shards")).cast("int")
    first = frames.staged(index.route(asked.withColumn("least", F.lit(None).cast("double")), True).withColumn("shard", home).drop("shards"), "first")
    hits = _visit(index.pages, first, k)
    least = best(hits).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("least"))
    rest = index.route(asked.join(least, "query_id", "left"), False).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    rest = rest.join(first.select("query_id", "cell", "shard"), ["query_id", "cell", "shard"], "left_anti")
    return best(hits.unionByName(_visit(index.pages, rest, k))).select("query_id", "rank", "vec_id", "score")
