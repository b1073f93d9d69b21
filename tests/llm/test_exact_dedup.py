import hashlib

from pyspark.sql import functions as F

from emberlog.llm import exact_dedup


def rows_of(spark):
    texts = ["a", "b", "a", "", None, "A", "a ", "b", "x" * 100000, "x" * 100000]
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, keep_id int").repartition(4)


def test_largest_id_stays(spark):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows_of(spark)).collect()}
    assert got == {0: (2, 2, False), 1: (7, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 1, True), 7: (7, 2, True), 8: (9, 2, False), 9: (9, 2, True)}
    sha = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_dedup(rows_of(spark)).collect()}
    assert sha[4] == hashlib.sha256(b"").hexdigest() and sha[8] == hashlib.sha256(b"x" * 100000).hexdigest()
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicated(rows_of(spark)).collect()) == [2, 4, 5, 6, 7, 9]


def test_texts_that_share_a_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(rows_of(spark)).collect()}
    assert got[0] == (2, 2) and got[5] == (5, 1) and got[8] == (9, 2) and len(got) == 10


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, "t"), (1, "t"), (None, "t"), (None, "u"), (None, "v"), (None, "v")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect())
    assert got == [(0, 0, 1, True), (0, 0, 2, False), (0, 0, 2, False), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup.exact_dedup(odd.limit(0)).collect() == []
