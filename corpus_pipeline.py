"""The corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing. Each stage works on all that the one before it kept.

Every stage but the last returns the columns of its documents. Rows whose ids repeat or are null are documents of their own throughout;
an empty table gives an empty result. Other columns are carried along whatever their names and types; a result keeps their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import exact_dedup, frames, language_id, ngram_join, packing, substring_dedup

#: A document of at least JUDGED n-grams whose best cosine is below this is like no language learnt: unrelated vectors have cosines with
#: a standard deviation of 1 / sqrt(dimensions), and this is five of them. Shorter texts have too few n-grams for the cosine to tell.
LEAST_SCORE, JUDGED = 5 / language_id.DIMENSIONS**0.5, 60
#: Near copies: shingles of five words, similarity of 0.8 or more.
GRAM, PERCENT = 5, 80


def _only(rows: DataFrame, uid: str, kept: DataFrame) -> DataFrame:
    """The rows whose uid is a doc_id of kept, without the uid."""
    (key,) = frames.free_names(rows, "__kept")
    return rows.join(kept.select(F.col("doc_id").alias(key)), F.col(uid) == F.col(key), "left_semi").drop(uid)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those of JUDGED n-grams or more like no language of the documents with a known one."""
    rows, uid = frames.with_row_ids(docs)
    names, table = language_id.prototypes(docs)
    found = language_id.identify(rows, names, table, id_col=uid)
    return _only(rows, uid, found.filter((F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | (F.col("n_grams") < JUDGED))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    rows, uid = frames.with_row_ids(docs)
    return _only(rows, uid, exact_dedup.exact_dedup(rows, id_col=uid).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, and what they are linked to, the document with the smallest id stays."""
    rows, uid = frames.with_row_ids(docs)
    return _only(rows, uid, ngram_join.near_components(rows, GRAM, PERCENT, id_col=uid).filter("doc_id = component_id"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that occur elsewhere; a document left without words goes, one without such passages stays as it is."""
    rows, uid = frames.with_row_ids(docs)
    key, text, gone = frames.free_names(rows, "__cut", "__text", "__removed")
    cut = substring_dedup.deduplicated(rows, id_col=uid).filter("n_removed = 0 or n_removed < n_words").select(F.col("doc_id").alias(key), F.col("text").alias(text), F.col("n_removed").alias(gone))
    made = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col(gone) > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.join(cut, F.col(uid) == F.col(key)).select(*[made.get(c, F.col(frames.quoted(c))).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("substring_dedup", substrings),
    ("packing", pack),
]

#: Hyperdimensional profiles and tokenisation are not expressible in SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = frames.settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        frames.dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
