import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from emberlog.llm import chunks, packing
from tests.llm.test_tokens import corpus


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(chunks.tokenizer_path("word_bpe_49k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for x in texts]


def padding(length, size=2048):
    return 0 if length & (length - 1) == 0 else size - length


def check(pieces, ids_of, size=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["start"]))
        ids = ids_of[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert set(by_doc) == set(ids_of)
    for doc, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(ids_of[doc])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    order = []
    for s in sorted(by_sequence):
        at = 0
        for offset, length, doc, start in sorted(by_sequence[s]):
            assert offset == at
            at += length
            order.append((doc, start))
        assert 0 < at <= size
    assert order == sorted(order)
    return {s: sum(x[1] for x in v) for s, v in by_sequence.items()}


def test_pieces_cover_the_library_ids(spark):
    texts = corpus() + ["One two. Three four! " * 900, "w " * 9000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("text", "text").repartition(3)
    pieces = packing.pack(frame)
    lengths = check(pieces.collect(), dict(enumerate(library_ids(texts))))
    assert sum(map(padding, lengths.values())) <= 0.02 * sum(lengths.values())
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(frame, pieces).collect()}
    assert all(len(rows[s]) == n + padding(n) for s, n in lengths.items())


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_of_least_cost(seed):
    rng = random.Random(seed)
    size, pos = 16, [0]
    while pos[-1] < 120:
        pos.append(pos[-1] + rng.randint(1, 7))
    cost = [rng.choice([0, 2, 9]) for _ in pos]
    f = [0] + [10**9] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            if pos[j] - pos[i] <= size:
                f[j] = min(f[j], f[i] + cost[j] + packing.SEQUENCE + padding(pos[j] - pos[i], size))
    cuts = packing.best_cuts(np.array(pos), np.array(cost), size)
    got, last = 0, 0
    for j in cuts:
        assert pos[j] - pos[last] <= size
        got, last = got + cost[j] + packing.SEQUENCE + padding(pos[j] - pos[last], size), j
    assert got == f[-1] and last == len(pos) - 1


def test_windows_and_odd_rows(spark, monkeypatch):
    packer = packing.Packer(64)
    monkeypatch.setattr(packing, "WINDOW", 1000)
    rng, ids_of, out = np.random.default_rng(1), {}, []
    for doc in range(300):
        ids = rng.integers(0, 9, rng.integers(1, 90)).astype("<u4")
        ids_of[doc] = ids
        packer.add(doc, ids, np.unique(rng.integers(1, len(ids) + 1, 4)))
        out += packer.rows()
    packer.solve(True)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    lengths = check([dict(zip(names, r)) for r in out + packer.rows()], ids_of, 64)
    assert sum(padding(n, 64) for n in lengths.values()) < 0.2 * sum(lengths.values())
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (1, "c")], "doc_id long, text string").selectExpr("*", "1 as length", "2 as uid")
    rows = packing.pack(odd).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in rows} == {(None, 1), (1, 2), (1, 3)} and sum(r["length"] for r in rows) == 9
