"""Plumbing that the two substring operators share: which keys occur more than once, and rows gathered by document.

Rows of a key meet in one task, so a task first settles what it can alone: a key that occurs twice in it is repeated whatever the others
hold. Such rows travel under keys of their own, marked known, and one row without a document speaks for the key. However common a key
is, no more rows of it than there are tasks come together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm import frames
from emberlog.llm.words import mix

ROWS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
DDL = "key long, doc_id long, at int, n int"
#: Rows whose key alone doesn't name the content for certain: check is the second half of a cryptographic name.
CHECKED = pa.schema([*ROWS, ("check", pa.int64())])
CHECKED_DDL = DDL + ", check long"


class Rows:
    """Buffers (key, doc_id, at, n) of a task and gives them out with what is known locally: n is negative in known rows.

    merge: known rows whose windows follow one another become one.
    checked: rows have a second half of their key, and are equal where both halves are.
    """

    def __init__(self, merge: bool = False, limit: int = 4_000_000, checked: bool = False):
        self.merge, self.limit, self.checked, self.held, self.size = merge, limit, checked, [], 0

    def add(self, key: np.ndarray, doc_id: np.ndarray, at: np.ndarray, n: np.ndarray, check: np.ndarray | None = None) -> None:
        columns = (key.view(np.int64), doc_id, at.astype(np.int32), n.astype(np.int32))
        self.held.append((*columns, check.view(np.int64)) if self.checked else columns)
        self.size += len(key)

    def out(self, final: bool):
        if not self.size or (self.size < self.limit and not final):
            return
        key, doc_id, at, n, *check = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        order = np.lexsort((check[0], key)) if check else np.argsort(key, kind="stable")
        first = np.ones(len(key), dtype=bool)
        first[1:] = np.diff(key[order]) != 0
        for c in check:
            first[1:] |= np.diff(c[order]) != 0
        single = first.copy()
        single[:-1] &= first[1:]
        alone = np.empty(len(key), dtype=bool)  # rows stay in the order of documents, which packs better
        alone[order] = single
        known = ~alone
        k_doc, k_at, k_n = doc_id[known], at[known], n[known]
        if self.merge and len(k_doc):
            by = np.lexsort((k_at, k_doc))
            k_doc, k_at, k_n = k_doc[by], k_at[by], k_n[by]
            start = np.ones(len(k_doc), dtype=bool)
            start[1:] = (k_doc[1:] != k_doc[:-1]) | (k_at[1:] != k_at[:-1] + k_n[:-1])
            k_doc, k_at, k_n = k_doc[start], k_at[start], np.add.reduceat(k_n, np.flatnonzero(start))
        yield from self._rows(key[alone], doc_id[alone], at[alone], n[alone], *[c[alone] for c in check])
        name = mix(mix(k_doc.view(np.uint64)) + k_at.astype(np.uint64)).view(np.int64)
        yield from self._rows(name, k_doc, k_at, -k_n, *[mix(name.view(np.uint64)).view(np.int64) for _ in check])
        speak = order[first & ~single]
        if len(speak):
            none = np.zeros(len(speak), np.int32)
            yield from self._rows(key[speak], pa.nulls(len(speak), pa.int64()), none, none, *[c[speak] for c in check])

    def _rows(self, *columns):
        schema = CHECKED if self.checked else ROWS
        for start in range(0, len(columns[0]), 200_000):
            yield frames.batch(schema, **{f.name: c[start : start + 200_000] for f, c in zip(schema, columns)})


def repeated(rows: DataFrame) -> DataFrame:
    """doc_id, at and n of the rows whose key (and check, if they have one) occurs more than once."""
    counted = rows.withColumn("__count", F.count(F.lit(1)).over(Window.partitionBy(*[c for c in ("key", "check") if c in rows.columns])))
    return counted.filter("doc_id is not null and (n < 0 or __count > 1)").select("doc_id", "at", F.abs("n").alias("n"))


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """doc_id and, for each column, the list of its values over the document's rows, in one order."""
    gathered = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("__rows"))
    return gathered.select("doc_id", *[F.col(f"__rows.{c}").alias(c) for c in columns])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some span [start, end) covers."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
