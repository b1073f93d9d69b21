"""Kinds, coercions, timestamps, windows and patterns over schemaless and typed rows."""

import json
import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.engine import Engine, bound
from emberlog.functions import times
from emberlog.functions.patterns import translate
from emberlog.functions.text import double_text, number_text
from emberlog.plans.errors import QueryError
from emberlog.sources.lines import detect

VALUES = ["null", "502", "502.0", "-3", "1e400", '"502"', '"502 "', '" 502"', '"1_000"', '"Inf"', '"NaN"', '""', '"abc"', '"5.2.3"', '"1e3"', "true", "false", "[1,2]", '{"a":1}', '{"a":1,"b":2}', None]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, '{"n":%d}' % k if v is None else '{"n":%d,"x":%s}' % (k, v)) for k, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "at long, line string").cache()


def hits(spark, lines, query):
    out = Engine(spark).lines(query, lines, "line", "at")
    return sorted(json.loads(r[0])["n"] for r in out.rows.df.select("__line").collect())


def of(*texts):
    return sorted(k for k, v in enumerate(VALUES) if v in texts)


def every(*but):
    return sorted(k for k, v in enumerate(VALUES) if v not in but)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("exists(x)", every(None)), ("not exists(x)", of(None)), ("x == null", of("null", "1e400")), ("x != null", every("null", "1e400", None)),
        ("x == 502", of("502", "502.0", '"502"')), ("x != 502", every("502", "502.0", '"502"', None)), ("not (x == 502)", every("502", "502.0", '"502"')),
        ('x == "502"', of('"502"', "502", "502.0")), ("x == 1000", of('"1e3"')), ("x == true", of("true")), ("x < true", of("false")), ("x > 0", of("502", "502.0", '"502"', '"1e3"')),
        ('x < "abc"', of('""', '" 502"', '"1_000"', '"1e3"', '"5.2.3"', '"502"', '"502 "', '"Inf"', '"NaN"')), ("x ~ '^5'", of('"502"', '"502 "', '"5.2.3"')), ("x !~ '^5'", of('" 502"', '"1_000"', '"Inf"', '"NaN"', '""', '"abc"', '"1e3"')),
        ("x in [502, 'abc', null]", of("502", "502.0", '"502"', '"abc"', "null", "1e400")), ("x in [true]", of("true")), ("x[1] == 2", of("[1,2]")), ("x.a == 1", of('{"a":1}', '{"a":1,"b":2}')), ("x[-1] == 1 or x[99999999999999999999] == 1", []),
        ("x == x", every(None)), ("x.a == x.b", []), ("1 == 1", every()), ("x > -1h", []), ("x <= 1h30", []), ("not (x > 5)", every("502", "502.0", '"502"', '"1e3"')), ("x >= -3 and x <= -3", of("-3")),
    ],
)
def test_truth_table(spark, lines, query, want):
    assert hits(spark, lines, query) == want


@pytest.mark.parametrize("null_as", ["null", "missing"])
def test_typed_rows_agree_with_lines(spark, null_as):
    rows = [(1, 1, 1.5, "a", True), (2, None, None, None, None), (3, 3, -2.0, "3", False), (4, 10, 1e9, "", None)]
    typed = spark.createDataFrame(rows, "id long, i long, f double, s string, b boolean")
    fields = lambda r: {k: v for k, v in zip(("id", "i", "f", "s", "b"), r) if v is not None or null_as == "null"}
    text = spark.createDataFrame([(r[0], json.dumps(fields(r))) for r in rows], "at long, line string")
    queries = ["i == 3", "i != 3", "not (i == 3)", "not (i != 3)", "i == null", "i != null", "exists(f)", "not exists(s)", 's == 3', 's < "b"', "s ~ 'a'", "s !~ 'a'", "not (s ~ 'a')", "b == true", "b != true", "not (b == false)", "i in [1, '10', null]", "f in [1.5]", "i < f", "i >= '3'", "s > 2", "f == '1.5'", "i == f or s == b", "not (i > 2 and f < 0)", "i == 'x'", "b < true", "ghost == 1 or not exists(ghost)"]
    for q in queries:
        left = sorted(r["id"] for r in Engine(spark).table(q, typed, ("id",), null_as=null_as).df.collect())
        right = sorted(json.loads(r[0])["id"] for r in Engine(spark).lines(q, text, "line", "at").rows.df.select("__line").collect())
        assert left == right, q


def test_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id * 1.5 as value", "cast(id as string) as name", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as ts").write.parquet(path)
    plan = Engine(spark).table("value >= 3 and name == 'x' and ts >= -1h and id in ['1']", spark.read.parquet(path), ("id",)).df._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters") :]
    assert all(x in pushed for x in ("GreaterThanOrEqual(value", "EqualTo(name,x)", "GreaterThanOrEqual(ts", "id"))
    narrow = Engine(spark).table("| stats sum(value) by name", spark.read.parquet(path), ("id",), max_groups=None).df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<value:decimal" in narrow.replace("struct<value:double", "struct<value:decimal") and "id:bigint" not in narrow[narrow.rindex("ReadSchema") :]


def test_levels(spark):
    rows = [(k, json.dumps({"n": k, "level": v})) for k, v in enumerate(["ERROR", "info", 35, "weird", "zzz", None, 60.9])]
    lines = spark.createDataFrame(rows, "at long, line string")
    assert hits(spark, lines, 'level >= "warn"') == [0, 3, 4, 6]  # unknown names compare by their bytes
    assert hits(spark, lines, 'level < "warn"') == [1, 2]
    assert hits(spark, lines, 'level == "error"') == []
    assert sorted(json.loads(r[0])["n"] for r in Engine(spark).lines('level >= "weird"', lines, "line", "at", levels={"weird": 35}).rows.df.select("__line").collect()) == [0, 2, 3, 4, 6]


STAMPS = {
    "2026-08-29T12:10:00Z": 1788005400_000000, "2026-08-29T12:10:00.123456789+02:00": 1787998200_123456, "2026-08-29T12:10:00": 1788005400_000000, "2026-08-29 12:10:00.5": 1788005400_500000,
    "2026/08/29 12:10:00": 1788005400_000000, "Sat, 29 Aug 2026 12:10:00 GMT": 1788005400_000000, "Sat, 29 Aug 2026 12:10:00 +0100": 1788001800_000000, "29/Aug/2026:12:10:00 -0700": 1788030600_000000,
    "1788005400": 1788005400_000000, "1788005400123": 1788005400_123000, "-5": -5_000000, "1969-12-31T23:59:59Z": -1_000000, "2026": 2026_000000,
    "2026-08-29": None, "12:00": None, "garbage": None, "2026-13-01T00:00:00Z": None, "2026-08-29T25:00:00Z": None, "1.5": None, "": None, "999999999999999": None,
}


def test_timestamp_texts(spark):
    df = spark.createDataFrame([(k,) for k in STAMPS], "s string")
    got = {r["s"]: r["m"] for r in df.select("s", times.parsed(F.col("s"), "UTC").alias("m")).collect()}
    assert got == STAMPS
    local = spark.createDataFrame([("2026-03-08 12:00:00",), ("2026-03-08T12:00:00Z",)], "s string").select(times.parsed(F.col("s"), "America/New_York")).collect()
    assert [r[0] for r in local] == [1772985600_000000, 1772971200_000000]


def test_first_resolvable_candidate_wins(spark):
    rows = [(0, '{"ts":"bad","time":"2024-01-01T00:00:00Z"}'), (1, '{"eventTime":1704067200000,"t":1.5}'), (2, '{"@timestamp":"1704067200"}'), (3, '{"ts":null}')]
    lines = spark.createDataFrame(rows, "at long, line string")
    got = [r["window"] for r in Engine(spark).lines("| stats count() every 24h", lines, "line", "at").df.collect()]
    assert got == ["(no-ts)", "2024-01-01T00:00:00Z"]


def test_civil_days_follow_the_zone(spark):
    rows = [(k, json.dumps({"ts": t})) for k, t in enumerate(["2026-03-08T04:59:00Z", "2026-03-08T05:00:00Z", "2026-03-09T03:59:00Z", "2026-03-09T04:00:00Z", "1969-12-31T23:30:00Z"])]
    lines = spark.createDataFrame(rows, "at long, line string")
    days = Engine(spark).lines("| stats count() every 24h", lines, "line", "at", tz="America/New_York").df.collect()
    assert {r["window"]: r["count"] for r in days} == {"1969-12-31T00:00:00-05:00": 1, "2026-03-07T00:00:00-05:00": 1, "2026-03-08T00:00:00-05:00": 2, "2026-03-09T00:00:00-04:00": 1}
    hours = Engine(spark).lines("| stats count() every 1h", lines, "line", "at", tz="Asia/Kolkata").df.collect()
    assert {r["window"] for r in hours} >= {"1970-01-01T04:30:00+05:30", "2026-03-08T10:30:00+05:30"}
    week = spark.createDataFrame([(k, f'{{"ts":"2026-06-{11 + k}T10:00:00Z"}}') for k in range(8)], "at long, line string")
    assert {r["window"]: r["count"] for r in Engine(spark).lines("| stats count() every 168h", week, "line", "at").df.collect()} == {"2026-06-11T00:00:00Z": 7, "2026-06-18T00:00:00Z": 1}


def test_fields_forget_the_timestamp(spark):
    lines = spark.createDataFrame([(0, '{"ts":"2024-01-01T00:00:00Z","a":1}')], "at long, line string")
    assert [r["window"] for r in Engine(spark).lines("| fields a | stats count() every 1h", lines, "line", "at").df.collect()] == ["(no-ts)"]


@pytest.mark.parametrize(("pattern", "text", "hit"), [("a$", "a\n", False), ("(?m)a$", "a\nb", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False), ("[[:alpha:]]+", "12", False), ("[[:alpha:]]", "x", True), ("(?P<n>x)y", "xy", True), ("\\s", "\x0b", False), ("[\\s]", " ", True), ("\\Qa.b\\E", "axb", False), ("^$", "", True), ("[]a]", "]", True), ("(?i)ABC", "xabc", True), ("\\d{2,}", "a12", True)])
def test_patterns(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "s string").select(F.col("s").rlike(translate(pattern))).collect()[0][0] == hit


@pytest.mark.parametrize("pattern", ["(", "(?=a)", "(a)\\1", "a++", "(?>a)", "(?U)a", "[[:bogus:]]", "a\\", "*a"])
def test_patterns_outside_the_dialect(pattern):
    with pytest.raises(QueryError, match="E-TYPE"):
        translate(pattern)


NUMBERS = [0.0, 1.0, -1.5, 812.0, 999999.0, 1e6, 1234567.5, 1e21, 1e-4, 0.00012345, 1e-5, 0.1, 123456.789, 5e-324, 1.7976931348623157e308, 100000.5, -2.5e-7, 0.001, 9999999.0]


def test_number_text(spark):
    want = ["0", "1", "-1.5", "812", "999999", "1e+06", "1.2345675e+06", "1e+21", "0.0001", "0.00012345", "1e-05", "0.1", "123456.789", "5e-324", "1.7976931348623157e+308", "100000.5", "-2.5e-07", "0.001", "9.999999e+06"]
    assert [number_text(x) for x in NUMBERS] == want
    got = [r[0] for r in spark.createDataFrame([(x,) for x in NUMBERS], "x double").select(double_text(F.col("x"))).collect()]
    assert [g for g in got if g != "4.9e-324"] == [w for w in want if w != "5e-324"]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=8, max_size=8))
def test_number_text_reads_back(raw):
    x = struct.unpack("<d", raw)[0]
    if math.isfinite(x):
        assert float(number_text(x)) == x


def test_detection():
    assert detect(b'{"a":1}\n\n{"b":2}') == "jsonl" and detect(b"a=1 b=2\nc=3") == "logfmt" and detect(b"a=1\nplain text") == "plain" and detect(b"") == "plain" and detect(b"\xef\xbb\xbf{}") == "jsonl" and detect(b'{"a":NaN}') == "plain"


def test_logfmt_lines(spark):
    rows = ['a=1 b="x \\"y\\" \\n" a=2', "a.b-c/d_e=", "   ", "bare", "=x", 'a="open', 'a="x"b=1', "a=1\tb=2", 'a="\\q"']
    lines = spark.createDataFrame(list(enumerate(rows)), "at long, line string")
    got = Engine(spark).lines("", lines, "line", "at", "logfmt").rows.df.select(F.to_json("__v"), "__seq.id").collect()
    assert {r[1]: json.loads(r[0]) for r in got} == {0: {"a": "2", "b": 'x "y" \n'}, 1: {"a.b-c/d_e": ""}, 2: {}, 7: {"a": "1\tb=2"}}


def test_depth_and_strictness(spark):
    deep = lambda n: '{"a":' + "[" * n + "]" * n + "}"
    rows = [deep(31), deep(32), '{"a":1} x', '{"a":1}{"b":2}', "[1]", "1", '{"a":01}', "{'a':1}", '{"a":1,}', '{"a":"[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[["}', " {} "]
    lines = spark.createDataFrame(list(enumerate(rows)), "at long, line string")
    assert sorted(r[0] for r in Engine(spark).lines("", lines, "line", "at").rows.df.select("__seq.id").collect()) == [0, 9, 10]


def test_bounds():
    assert bound("now", 7) == 7 and bound("-1s", 2_000_000) == 1_000_000 and bound("1970-01-01T01:00:00+01:00", 0) == 0
    with pytest.raises(ValueError):
        bound("1970-01-01", 0)


def test_guard_keeps_the_first_groups(spark):
    df = spark.createDataFrame([(k, g, k) for k, g in enumerate("abcdabz")], "id long, g string, v long")
    got = Engine(spark).table("| stats count(), sum(v), count_distinct(v), p50(v) by g", df, ("id",), max_groups=3).df.collect()
    assert [tuple(r) for r in got] == [("a", 2, 4, 2, 0), ("b", 2, 6, 2, 1), ("c", 1, 2, 1, 2), ("(other)", 2, 9, None, 3)]


def test_large_sums_and_empty_input(spark):
    df = spark.createDataFrame([(1, 2**63 - 1), (2, 2**63 - 1), (3, None)], "id long, v long")
    from emberlog import render

    out = Engine(spark).table("| stats sum(v), count_distinct(v)", df, ("id",))
    assert list(render.records(out)) == [{"sum_v": 2.0 * (2**63 - 1), "count_distinct_v": 2}]
    empty = Engine(spark).table("id > 9 | stats count(), sum(v), avg(v), max(v), p99(v), count_distinct(v)", df, ("id",))
    assert list(render.records(empty)) == [{"count": 0, "sum_v": 0, "avg_v": "(none)", "max_v": "(none)", "p99_v": "(none)", "count_distinct_v": 0}]
    assert Engine(spark).table("id > 9 | stats count() by v", df, ("id",)).df.collect() == []


def test_names_of_the_table_never_meet_the_engines_own(spark):
    rows = [(1, 7, "x", 1.0), (1, 8, "y", 2.0), (1, 8, "x", 4.0)]
    df = spark.createDataFrame(rows, "id int, __by0 int, __window string, __n double")
    out = Engine(spark).table("| stats count(), sum(__n) by id, __by0", df, ("__n",))
    assert [tuple(r) for r in out.df.collect()] == [(1, 7, 1, 1.0), (1, 8, 2, 6.0)] and out.df.columns == ["id", "__by0", "count", "sum___n"]
    assert [tuple(r) for r in Engine(spark).table("__by0 == 8 | fields __window, __by0 | sort __window desc limit 1", df, ("__n",)).df.collect()] == [("y", 8)]


def test_names_that_differ_in_case(spark):
    both = spark.createDataFrame([(1, 10), (1, 20), (2, 30)], "a int, A int")
    assert [tuple(r) for r in Engine(spark).table("A >= 20 | stats sum(a), sum(A) by a", both).df.collect()] == [(1, 1, 20), (2, 2, 30)]
    assert [tuple(r) for r in Engine(spark).table("| fields A, a | sort A desc limit 2", both, ("a", "A")).df.collect()] == [(30, 2), (20, 1)]
    lines = spark.createDataFrame([(0, '{"a":1,"A":2}'), (1, '{"a":1,"A":3}'), (2, '{"A":3}')], "at long, line string")
    assert [tuple(r) for r in Engine(spark).lines("| stats count(), sum(a), sum(A) by a, A", lines, "line", "at").df.collect()] == [(None, "3", 1, 0, 3), ("1", "2", 1, 1, 2), ("1", "3", 1, 1, 3)]


@pytest.mark.parametrize(("query", "want"), [
    ("v > 1", [2, 5]), ("v >= 1", [1, 2, 5]), ("v < 2", [1]), ("1 < v", [2, 5]), ("v != 1", [0, 2, 3, 4, 5]), ("v == null", [0, 3, 4]), ("not (v > 1)", [0, 1, 3, 4]), ("v in [2, 1]", [1, 2]),
])
def test_nan_reads_as_null(spark, query, want):
    nan = float("nan")
    df = spark.createDataFrame([(0, nan), (1, 1.0), (2, 2.0), (3, None), (4, nan), (5, float("inf"))], "id int, v double")
    assert [r["id"] for r in Engine(spark).table(query, df, ("id",)).df.orderBy("id").collect()] == want
    finite = df.filter("id < 5")
    row = Engine(spark).table("| stats sum(v), avg(v), max(v), p95(v), count_distinct(v)", finite, ("id",)).df.collect()[0]
    assert tuple(row) == (3.0, 1.5, 2.0, 2.0, 3)
    assert [tuple(r) for r in Engine(spark).table("| stats count() by v", finite, ("id",)).df.collect()] == [(None, 3), (1.0, 1), (2.0, 1)]
    assert [r["id"] for r in Engine(spark).table("not exists(v)", df, ("id",), null_as="missing").df.collect()] == [0, 3, 4]
    assert [r["id"] for r in Engine(spark).table("v != 1", df, ("id",), null_as="missing").df.orderBy("id").collect()] == [2, 5]
    plan = Engine(spark).table("v > 1 and v < 5", df).df._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" not in plan
