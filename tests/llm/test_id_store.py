import zlib

import numpy as np
import pytest

from emberlog.llm import id_store
from tests.llm.test_packing import library_ids
from tests.llm.test_tokens import corpus


def test_round_trip_equals_the_library(spark, tmp_path):
    texts = corpus() + ["w x y " * 9000, "same text here. " * 300, "same text here. " * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, start = {}, 0
    for k, ids in enumerate(library_ids(texts)):
        want[k] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in id_store.round_trip(frame).collect()}
    assert got == want
    path = str(tmp_path / "store")
    id_store.write(frame, path)
    ids = library_ids(texts)
    assert all(r["ids"] == ids[r["doc_id"]].tolist() for r in id_store.read_ids(spark, path).collect())
    stored = spark.read.parquet(f"{path}/chunks")
    assert stored.count() == stored.select("digest").distinct().count()


def test_damage_is_found(spark, tmp_path):
    frame = spark.createDataFrame([(0, "a b c"), (1, "d e f")], "doc_id long, text string")
    id_store.write(frame, str(tmp_path / "a"))
    chunks = spark.read.parquet(str(tmp_path / "a" / "chunks")).collect()
    for name in ("recipes", "manifest"):
        spark.read.parquet(str(tmp_path / "a" / name)).write.parquet(str(tmp_path / "b" / name))
    spark.createDataFrame([(r["digest"], bytes(r["data"][:-1]) + b"\x7f") for r in chunks], "digest binary, data binary").write.parquet(str(tmp_path / "b" / "chunks"))
    with pytest.raises(Exception, match="damaged"):
        id_store.read_back(spark, str(tmp_path / "b")).collect()


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 40000, 20000).astype(np.uint32)
    ends = id_store.chunk_ends(body, np.array([0, len(body)]))
    moved = id_store.chunk_ends(np.concatenate([body[:7], body]), np.array([0, len(body) + 7]))
    assert len(set(ends.tolist()) & set((moved - 7).tolist())) > 0.9 * len(ends)
    assert np.diff(id_store.chunk_ends(np.zeros(10000, np.uint32), np.array([0, 10000]))).max() <= id_store.LONGEST


def test_shared_passages_are_stored_once():
    rng = np.random.default_rng(1)
    passages = [rng.integers(0, 40000, 1000) for _ in range(20)]
    documents = [np.concatenate([rng.integers(0, 40000, 300), passages[k % 20], rng.integers(0, 40000, 300)]) for k in range(100)]
    ids, offsets = np.concatenate(documents).astype(np.uint32), np.arange(101) * 1600
    ends = id_store.chunk_ends(ids, offsets)
    stored = {ids[a:b].tobytes(): b - a for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)}
    assert len(ids) - sum(stored.values()) > 0.4 * 80 * 1000
    body = rng.integers(0, 40000, 20000).astype(np.uint32)
    ends = id_store.chunk_ends(body, np.array([0, len(body)]))
    moved = id_store.chunk_ends(np.concatenate([body[:7], body]), np.array([0, len(body) + 7]))
    assert len(ends) > 50 and len(set(ends.tolist()) & set((moved - 7).tolist())) > 0.9 * len(ends)
    assert np.diff(id_store.chunk_ends(np.zeros(10000, np.uint32), np.array([0, 10000]))).max() <= 4096


def test_crc_of_parts():
    data = bytes(range(256)) * 5
    cuts = [0, 1, 7, 100, 100, 1280]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    crc = np.array([zlib.crc32(p) for p in parts], dtype=np.uint32)
    after = np.array([len(data) - b for b in cuts[1:]])
    assert np.bitwise_xor.reduce(id_store.shifted(crc, after)) == zlib.crc32(data)


def test_odd_rows(spark):
    assert id_store.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 5), (0, "c", None)], "doc_id long, text string, digest int")
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"]) for r in id_store.round_trip(odd).collect()) == [(-1, 0, 1), (0, 1, 2), (1, 3, 3), (1, 6, 3)]
