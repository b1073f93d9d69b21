"""Small Spark helpers shared by the corpus operators: shared storage, ids, batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker expands at once. Bounds the numpy scratch space of a task.
CHUNK_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            where = current
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            where = tempfile.mkdtemp(prefix="emberlog-")
            spark.sparkContext.setCheckpointDir(where)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where.rstrip("/")


#: With this, Spark removes the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables staged since the innermost settled() began.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("_scope", default=None)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage. The files go when the application ends, or before
    by settled() or dropped(); the shuffle files behind them go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberlog-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    _remove_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    scope = _scope.get()
    if scope is not None:
        scope.append(table)
    return table


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """staged() of what make() returns; the files of all tables that make() staged go then."""
    token = _scope.set(own := [])
    try:
        made = make()
    finally:
        _scope.reset(token)
    out = staged(made, name)
    dropped(*own)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables from staged() that nothing reads any more."""
    for table in tables:
        _quietly_removed(table.sparkSession, table._staged_at)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_quietly_removed, spark, path)


def _quietly_removed(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id and text alone (null text: empty), whatever else df carries."""
    return df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))


def unique_ids(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with ids that are unique and not null, and a function that puts the given ids back into a result.

    Most inputs have such ids already and pass through. Otherwise rows are numbered by (id with nulls first, text), so equal
    rows are documents of their own that follow one another.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").limit(1)
    if not odd.take(1):
        return docs, lambda result: result
    numbered = staged(dense_numbers(docs, [F.col("doc_id").asc_nulls_first(), F.col("text")], "uid"), "ids")
    names = numbered.select("uid", F.col("doc_id").alias("given"))

    def restore(result: DataFrame) -> DataFrame:
        back = result.join(names, result["doc_id"] == names["uid"])
        return back.select(*[F.col("given").alias("doc_id") if c == "doc_id" else result[c] for c in result.columns])

    return numbered.select(F.col("uid").alias("doc_id"), "text"), restore


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it differ from df's columns in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def _sortable(field: T.StructField) -> Column:
    """The column itself, or its JSON text where its type has no order."""
    column = F.col(quoted(field.name))
    ordered = lambda t: all(map(ordered, [f.dataType for f in t])) if isinstance(t, T.StructType) else ordered(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType, T.CalendarIntervalType))
    return column if ordered(field.dataType) else F.to_json(F.struct(column))


def with_row_ids(df: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """df with one more column that is unique and not null, and its name: the id itself where ids are so, else numbers in the order of (id, all columns)."""
    key = F.col(quoted(id_col)).cast("long")
    (uid,) = free_names(df, "__uid")
    odd = df.groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").limit(1)
    if not odd.take(1):
        return df.withColumn(uid, key), uid
    return staged(dense_numbers(df, [key.asc_nulls_first(), *[_sortable(f) for f in df.schema if f.name != id_col]], uid), "rows"), uid


def dense_numbers(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number rows from 0 in the given order: a range partitioning, then each partition's base from the partitions' counts."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, row, tie = free_names(df, "__part", "__row", "__tie")
    order = [*order, F.col(tie)]  # equal rows, however many, are split too
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(tie)
    local = staged(ranged.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(row)), "ranged")
    return with_bases(local, part, row, name)


def with_bases(df: DataFrame, part: str, row: str, name: str) -> DataFrame:
    """name = row + the number of rows in all parts before; part is a partition number, so there are few of them."""
    counts = df.groupBy(part).agg((F.max(row) + 1).alias("rows"))
    total = 0
    bases = []
    for r in counts.orderBy(part).toLocalIterator():  # one row for each partition
        bases.append((r[0], total))
        total += r["rows"]
    (base,) = free_names(df, "__base")
    table = df.sparkSession.createDataFrame(bases, f"`{part}` int, `{base}` long")
    return df.join(F.broadcast(table), part).withColumn(name, F.col(row) + F.col(base)).drop(part, row, base)


def pieces(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array whose texts have about limit bytes together; a longer text is alone."""
    start, n = 0, len(array)
    if not n:
        return
    ends = np.cumsum(byte_lengths(array))
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def byte_lengths(array: pa.Array) -> np.ndarray:
    wide = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.diff(offsets)


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string array in a row, and the n + 1 offsets of the texts in them. No nulls."""
    wide = array.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from arrays by name, cast to the schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in schema], schema=schema)
