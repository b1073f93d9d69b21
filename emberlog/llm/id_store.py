"""Token-ID output in a content-addressed store (10).

A document's ids, with an end id, are cut where a rolling hash of the last RING ids has its lowest bits clear, so equal stretches of
different documents give equal chunks. The store has two Parquet tables:

    chunks/   digest (the first DIGEST bytes of the SHA-256 of data), data: one byte for the width of an id, 2 or 4, then the ids, little-endian. Each digest once.
    recipes/  __part, doc_id, n_tokens, digests, lengths, root (Merkle root of the digests), local_start; parts ascend by doc_id.
    manifest/ __part, the part's ids and its Merkle root over the documents' roots.

Reading checks every chunk against its digest and every document's and part's digests against their Merkle roots; a mismatch is an error.
A task sends each digest's data once; one row a task and digest at most meets in the table of chunks, however common a chunk is.

Null and empty texts are an end id alone. Very long documents have many chunks. Rows with a null or repeated id are documents in the
order of (id, text). An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import chunks, frames
from emberlog.llm.words import mix, powers

RING = 8
#: A chunk ends where this many low bits of the rolling hash are clear, and after LONGEST ids at the latest.
BITS, LONGEST = 8, 4096
#: Bytes of a digest: 128 bits of SHA-256. Merkle nodes above the digests are whole SHA-256 hashes.
DIGEST = 16
#: Digests that a task remembers as sent, before it starts anew.
REMEMBERED = 100_000

DOC = "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, fresh array<struct<at:int,data:binary>>"


def chunk_ends(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents' ids; a document's end is always one."""
    value = mix(ids.astype(np.uint64) + np.uint64(1))
    rolling, factors = np.zeros(len(ids), dtype=np.uint64), powers(RING)
    for back in range(min(RING, len(ids))):
        rolling[back:] += value[: len(value) - back] * factors[back]
    begins = np.repeat(offsets[:-1], np.diff(offsets))
    cut = ((rolling >> np.uint64(64 - BITS)) == 0) & (np.arange(len(ids)) - begins >= RING - 1)
    ends = np.union1d(np.flatnonzero(cut) + 1, offsets[1:])
    gaps = np.diff(ends, prepend=0)
    more = (gaps - 1) // LONGEST
    if more.any():
        firsts = np.repeat(ends - gaps, more)
        steps = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.union1d(ends, firsts + steps * LONGEST)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:DIGEST]


def merkle(digests: list[bytes]) -> bytes:
    """Root over digests; an odd one at the end of a level goes up as it is."""
    level = list(digests)
    while len(level) > 1:
        level = [hashlib.sha256(level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def packed(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype("<u4")


def _documents(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int) -> Iterator[pa.RecordBatch]:
    pair = pa.struct([("at", pa.int32()), ("data", pa.binary())])  # at: place in the document's digests
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("root", pa.binary()), ("fresh", pa.list_(pair))])
    tokens, sent = chunks.word_ids(vocabulary), set()
    for batch in chunks.groups(batches):
        ids, offsets, *_ = tokens(batch.column(1), end)
        ends = chunk_ends(ids, offsets)
        starts = np.concatenate([[0], ends[:-1]])
        first = np.searchsorted(starts, offsets)
        small = len(ids) and int(ids.max()) < 65536
        body = ids.astype("<u2" if small else "<u4")
        datas = [b"\x02" + body[a:b].tobytes() if small else packed(body[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        digests = [digest(x) for x in datas]
        if len(sent) > REMEMBERED:
            sent = set()
        new = []
        for k, d in enumerate(digests):
            if d not in sent:
                sent.add(d)
                new.append(k)
        spans = np.searchsorted(new, first)
        at = np.array(new, dtype=np.int64) - np.repeat(first[:-1], np.diff(spans))
        pairs = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array([datas[k] for k in new], pa.binary())], fields=list(pair))
        fresh = pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pairs)
        lists = pa.array(first.astype(np.int32))
        yield frames.batch(
            schema, doc_id=batch.column(0), n_tokens=np.diff(offsets), digests=pa.ListArray.from_arrays(lists, pa.array(digests, pa.binary())), lengths=pa.ListArray.from_arrays(lists, pa.array((ends - starts).astype(np.int32))),
            root=[merkle(digests[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], fresh=fresh,
        )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest of a partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _local_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = total + np.cumsum(n)
        rows = [*batch.columns, pa.array(ends - n), pa.array(np.full(len(n), part, np.int32))]
        total = int(ends[-1]) if len(n) else total
        yield pa.RecordBatch.from_arrays(rows, names=[*batch.schema.names, "local_start", "__part"])


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part: number, ids, Merkle root. Parts are read whole and in order by one task each."""
    found: dict[int, tuple[list[bytes], int]] = {}
    for batch in batches:
        for part, n, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            roots, total = found.get(part, ([], 0))
            roots.append(root)
            found[part] = (roots, total + n)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x[1] for x in found.values()], pa.int64()), pa.array([merkle(x[0]) for x in found.values()], pa.binary())], names=["__part", "n_ids", "root"])


def write(df: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of df's documents as a store at path; ids must be unique and not null (see frames.unique_ids)."""
    docs = frames.documents(df, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = frames.staged(docs.mapInArrow(lambda it: _documents(it, vocabulary, end), DOC), "tokenised")
    fresh = made.select(F.explode(F.transform("fresh", lambda x: F.struct(F.get("digests", x["at"]).alias("digest"), x["data"].alias("data")))).alias("x")).select("x.digest", "x.data")
    fresh.repartition(parts, "digest").mapInArrow(_once, "digest binary, data binary").write.option("compression", "zstd").parquet(f"{path}/chunks")
    ranged = made.drop("fresh").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(_local_starts, "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, local_start long, __part int").write.option("compression", "zstd").parquet(f"{path}/recipes")
    recipes = df.sparkSession.read.parquet(f"{path}/recipes")
    roots = recipes.select("__part", "n_tokens", "root", "doc_id").repartition(parts, "__part").sortWithinPartitions("__part", "doc_id").drop("doc_id")
    roots.mapInArrow(_part_roots, "__part int, n_ids long, root binary").write.parquet(f"{path}/manifest")


POLYNOMIAL = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2), modulo that of CRC-32, lowest power in the highest bit."""
    out = np.zeros(len(b), dtype=np.uint32)
    b = b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), POLYNOMIAL, np.uint32(0))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What the CRC-32 of a part adds to the CRC-32 of a whole in which n_bytes follow it."""
    out, left = crc.astype(np.uint32), n_bytes.astype(np.uint64)
    power = np.array([1 << 23], dtype=np.uint32)  # x ** 8
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(np.broadcast_to(power, odd.sum()), out[odd])
        power = _times(power, power)
        left >>= np.uint64(1)
    return out


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, crc and number of ids of each stored chunk, whose data must have that digest."""
    schema = pa.schema([("digest", pa.binary()), ("crc", pa.int64()), ("n", pa.int32())])
    for batch in batches:
        digests, datas = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for d, x in zip(digests, datas):
            if digest(x) != d:
                raise ValueError(f"chunk {d.hex()} is damaged")
        yield frames.batch(schema, digest=batch.column(0), crc=[zlib.crc32(unpacked(x).tobytes()) for x in datas], n=[(len(x) - 1) // x[0] for x in datas])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens and ids_crc32 from rows of doc_id, start, n_tokens, root and the sorted chunks found."""
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])
    for batch in batches:
        lists = batch.column(4)
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        flat = lists.flatten()
        bounds = bounds - bounds[0]
        crc, n = flat.field("crc").to_numpy().astype(np.uint32), flat.field("n").to_numpy().astype(np.int64)
        digests = flat.field("digest").to_pylist()
        total = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=total[1:])
        after = np.repeat(total[bounds[1:]], np.diff(bounds)) - total[1:]
        parts = shifted(crc, 4 * after)
        for k, (doc_id, want, root) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if total[bounds[k + 1]] - total[bounds[k]] != want or merkle(digests[bounds[k] : bounds[k + 1]]) != root:
                raise ValueError(f"document {doc_id} can't be rebuilt from the store")
        yield frames.batch(schema, doc_id=batch.column(0), start=batch.column(1), n_tokens=batch.column(2), ids_crc32=np.bitwise_xor.reduceat(parts, bounds[:-1]).astype(np.int64) if len(n) else np.zeros(0, np.int64))


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with each document's start, after every part's Merkle root agreed with the manifest."""
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = recipes.select("__part", "n_tokens", "root", "doc_id").repartition(parts, "__part").sortWithinPartitions("__part", "doc_id").drop("doc_id").mapInArrow(_part_roots, "__part int, n_ids long, root binary")
    if again.exceptAll(manifest).unionAll(manifest.exceptAll(again)).take(1):
        raise ValueError(f"{path}: the recipes don't agree with the manifest")
    total, bases = 0, []
    for part, n in manifest.select("__part", "n_ids").orderBy("__part").toLocalIterator():  # one row for each part
        bases.append((part, total))
        total += n
    return recipes.join(F.broadcast(spark.createDataFrame(bases, "__part int, base long")), "__part").withColumn("start", F.col("base") + F.col("local_start"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of a store, from its files alone."""
    stored = spark.read.parquet(f"{path}/chunks").select("digest", "data").mapInArrow(_checked, "digest binary, crc long, n int")
    wanted = _recipes(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("at", "digest"))
    own = ("start", "n_tokens", "root")  # what belongs to the document goes with its first chunk alone
    wanted = wanted.select("doc_id", "at", "digest", *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in own])
    found = wanted.join(stored, "digest").groupBy("doc_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in own], F.sort_array(F.collect_list(F.struct("at", "digest", "crc", "n"))).alias("chunks"))
    return found.mapInArrow(_whole, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of long) of each document of a store."""
    schema = pa.schema([("digest", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield frames.batch(schema, digest=batch.column(0), ids=[unpacked(x).astype(np.int64) for x in batch.column(1).to_pylist()])

    stored = spark.read.parquet(f"{path}/chunks").select("digest", "data").mapInArrow(run, "digest binary, ids array<long>")
    wanted = _recipes(spark, path).select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    whole = wanted.join(stored, "digest").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return whole.select("doc_id", "start", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))


def round_trip(df: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    import uuid

    spark = df.sparkSession
    docs, restore = frames.unique_ids(frames.documents(df, id_col, text_col))
    path = f"{frames.shared_dir(spark)}/emberlog-{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex[:12]}"
    write(docs, path, vocabulary, end)
    frames._remove_at_exit(spark, path)
    return restore(read_back(spark, path))
