import random

import corpus_pipeline
from emberlog.llm import language_id, packing
from tests.llm import brute
from tests.llm.test_packing import check, library_ids

FR, EN = "le chat est dans la maison avec une belle fleur rouge et nous allons bientôt", "the quick brown fox jumps over that lazy dog while we think about something"


def documents():
    rng = random.Random(4)
    make = lambda lang, n: " ".join(rng.choice((FR if lang == "fr" else EN).split()) + rng.choice(["", "e", "s"]) for _ in range(n)) + "."
    rows = []
    for k in range(60):
        lang = rng.choice(["en", "fr"])
        rows.append([k, make(lang, rng.randint(20, 120)), lang])
    passage = make("en", 60)
    rows += [[60, rows[3][1], rows[3][2]], [61, rows[3][1], rows[3][2]], [62, rows[5][1].replace(" ", "  ", 1), "en"], [63, "12 34 !!", "en"], [64, None, None], [65, "", "fr"]]
    rows += [[66, make("en", 50) + " " + passage, "en"], [67, passage + " " + make("en", 40), "en"], [68, passage + " x", "en"]]
    near = rows[10][1].split()
    near[-1] = "changed"
    rows.append([69, " ".join(near), rows[10][2]])
    return [(k, t, lang, "src", len(t or "")) for k, t, lang in rows]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs.append(docs)
        if name != "packing":
            assert set(docs.columns) == set(frame.columns)
    kept = lambda k: {r["doc_id"]: r["text"] for r in outs[k].collect()}
    want = {k: t for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert kept(0) == want
    last = {}
    for k in sorted(want):
        last[want[k]] = k
    want = {k: want[k] for k in last.values()}
    assert kept(1) == want
    groups = brute.components(want, 5, 80)
    want = {k: t for k, t in want.items() if groups[k][1] == k}
    assert kept(2) == want and 69 not in want
    marks = brute.substring(want, 35)
    got = kept(3)
    assert {k for k in got} == {k for k in want if marks[k][1] < marks[k][0] or not marks[k][1]}
    assert all(got[k] == want[k] for k in got if not marks[k][1])
    assert all(len(got[k].split()) == marks[k][0] - marks[k][1] for k in got) and any(marks[k][1] for k in got)
    assert all(r["n_chars"] == len(r["text"]) for r in outs[3].collect())
    check(outs[4].collect(), dict(zip(got, library_ids(got.values()))))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == outs[4].count()


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __n int, segment string"
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, EN, "en", None, None, 1, "x"), (1, EN, "en", None, None, 1, "x"), (None, FR, None, "s", 5, None, None), (None, None, None, None, None, None, None), (2, FR + " deux", "fr", "s", 5, 2, "y")], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").collect() == [] and stage(spark, odd, "").columns == odd.columns
    assert corpus_pipeline.exact(spark, odd, "").count() == 4
    assert packing.pack(odd).count() >= 5


def test_columns_of_any_name_and_type(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed long, __uid string, __kept int, __part int, __row int, __base int, `a.b` int, tags map<string,int>, deep array<struct<m:map<string,int>>>"
    rest = (7, "own", 1, 2, 3, 4, 5, {"a": 1}, [({"b": 2},)])
    odd = spark.createDataFrame([(1, EN, "en", "s", 5, *rest), (1, EN + " more", "en", "s", 5, *rest), (None, FR, "fr", None, None, None, None, None, None, None, None, None, None, None)], schema)
    sound = odd.filter("doc_id is not null").limit(1)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns
        assert [tuple(r) for r in stage(spark, sound, "").collect()] == [tuple(r) for r in sound.collect()]
    assert sorted((r["__uid"] or "", r["n_removed"] or 0) for r in corpus_pipeline.exact(spark, odd, "").collect()) == [("", 0), ("own", 7), ("own", 7)]


def test_held_out_accuracy(spark):
    rows = [r for r in documents() if r[1] and any(c.isalpha() for c in r[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in language_id.language_id(frame).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 8 and all(got[r[0]]["lang_pred"] == r[2] for r in held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 ...", "fr"), (None, "le chat", "fr")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(odd).collect()} == {1: "und", 2: "und", 3: "und", None: "fr"}
    assert language_id.language_id(odd.limit(0)).collect() == []


def test_texts_like_no_language_go(spark):
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    scripts = {"cyrillic": [chr(c) for c in range(0x430, 0x450)], "greek": [chr(c) for c in range(0x3B1, 0x3CA)], "han": [chr(c) for c in range(0x4E00, 0x5200)], "latin": "abcdefghijklmnopqrstuvwxyz", "hex": "0123456789abcdef"}
    strange = [" ".join(word(letters) for _ in range(n)) for letters in scripts.values() for n in (40, 200) for _ in range(20)]
    real = [r for r in documents() if r[1] and any(c.isalpha() for c in r[1])]
    rows = real + [(1000 + k, t, None, "strange", len(t)) for k, t in enumerate(strange)] + [(2000, "Да.", None, "short", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.language(spark, frame, "").collect()]
    assert set(got) == {r[0] for r in real} | {2000}


def test_every_labelled_language_is_learnt(spark):
    rows = [(k, "the quick brown fox", "en") for k in range(4000)] + [(4000 + k, "le chat dans la maison", "fr") for k in range(3)]
    names, table = language_id.prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_training=50)
    assert names == ["en", "fr"] and abs((table**2).sum() - 2) < 1e-9


def test_max_training_is_a_bound(spark):
    rows = [(k, f"word{k} the thing", "en") for k in range(400)]
    names, table = language_id.prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_training=50)
    assert names == ["en"] and abs((table**2).sum() - 1) < 1e-9
