"""Exact dedup by skew-safe combining (2): local winners, winners of salted digest groups, then global winners.

Every stage groups by the digest and by the whole text, so texts that merely share a digest stay apart. The salt is the input
partition's number modulo SALTS: a map-side combine leaves one row for each distinct text of a partition, the salted stage at most one
for each salt, and the last stage meets at most SALTS rows of any text, however many copies there are.

Null and empty texts are equal texts. Null ids count in group_size; a group of null ids alone has keep_id null, and no row of it with
a null id is kept but where a single row has that text. Rows that repeat an id with the same text are copies of one document: all of them are kept or dropped
together. Very long texts are compared whole, like all others. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import frames

SALTS = 16


def winners(docs: DataFrame) -> DataFrame:
    """digest, text, keep_id (largest doc_id) and group_size of each distinct text of docs (doc_id, text)."""
    totals = lambda df: df.agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    rows = docs.select(F.sha2(F.col("text"), 256).alias("digest"), "text", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    salted = totals(rows.groupBy("digest", "salt", "text"))
    return totals(salted.groupBy("digest", "text"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; of equal texts the row with the largest id stays."""
    docs = frames.documents(df, id_col, text_col)
    found = winners(docs)
    by_digest = frames.staged(
        found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")),
        "winners",
    )
    keyed = docs.select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))
    out = keyed.join(by_digest.filter("texts = 1").drop("texts"), "digest")
    shared = by_digest.filter("texts > 1").select("digest")
    if shared.take(1):  # two texts with one digest: those documents are joined by their texts too
        keyed = docs.withColumn("digest", F.sha2(F.col("text"), 256)).join(shared, "digest", "left_semi")
        out = out.unionByName(keyed.join(winners(docs).join(shared, "digest", "left_semi"), ["digest", "text"]).drop("text"))
    kept = (F.col("doc_id") == F.col("keep_id")) | (F.col("doc_id").isNull() & (F.col("group_size") == 1))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns."""
    marks = exact_dedup(df, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return df.join(marks, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")
