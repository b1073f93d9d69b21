import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.plans import durations
from emberlog.plans.errors import QueryError, suggest
from emberlog.plans.nodes import Aggregate, And, Compare, Exists, Fields, In, Limit, Literal, Match, Not, Or, Path, Sort, Stats
from emberlog.plans.parser import parse

P = lambda *s: Path(tuple(s))
N = lambda v: Literal("number", v)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x == 1", Compare("==", P("x"), N(1))),
        ("a.b[2].\"c d\" != -1.5e3", Compare("!=", P("a", "b", 2, "c d"), N(-1500.0))),
        ('."http-status" >= 500', Compare(">=", P("http-status"), N(500))),
        ('"foo" == "bar"', Compare("==", Literal("string", "foo"), Literal("string", "bar"))),
        ("ts >= -1h30m", Compare(">=", P("ts"), Literal("duration", "-1h30m"))),
        ("x in [1, 'a', null, true]", In(P("x"), (N(1), Literal("string", "a"), Literal("null", None), Literal("bool", True)))),
        ("not not exists(a.count)", Not(Not(Exists(P("a", "count"))))),
        ("a == 1 or b == 2 and not c == 3", Or(Compare("==", P("a"), N(1)), And(Compare("==", P("b"), N(2)), Not(Compare("==", P("c"), N(3)))))),
        ("msg !~ '^a\\\\d'", Match(P("msg"), "^a\\d", True)),
        ("x == 99999999999999999999", Compare("==", P("x"), N(1e20))),
        ("x == .5", Compare("==", P("x"), N(0.5))),
        ("a[99999999999999999999] == 1", Compare("==", P("a", 2**62 - 1), N(1))),
    ],
)
def test_filters(text, want):
    assert parse(text).filter == want


def test_stages():
    q = parse("| stats count(), p95(a.b) by svc, items[0] every 1h | sort count desc limit 5 | limit 2")
    assert q.filter is None
    assert q.stages == (Stats((Aggregate("count", None), Aggregate("p95", P("a", "b"))), (P("svc"), P("items", 0)), 3_600_000_000), Sort(P("count"), True, 5), Limit(2))
    assert [f.column for f in q.stages[0].functions] == ["count", "p95_a_b"]
    assert parse("x == 1 | fields a, b.c | sort a limit 1").stages == (Fields((P("a"), P("b", "c"))), Sort(P("a"), False, 1))
    assert parse("  ").filter is None


@pytest.mark.parametrize(
    ("text", "start"),
    [
        ("x == ", "1:6: E-PARSE"), ("x =", "1:3: E-PARSE"), ("(x == 1", "1:8: E-PARSE"), ("x", "1:2: E-PARSE: nothing is asked"), ("stats count()", "1:1: E-PARSE"),
        ("| sort x", "1:9: E-PARSE: say how many"), ("| limit 0", "1:9: E-PARSE"), ("| stats count() | fields x", "1:17: E-PARSE"),
        ("| stats count(), count()", "1:18: E-PARSE: \"count()\" is asked for twice"), ("| stats count() every 7d", "1:23: E-PARSE"), ("| stats count() every 1us", "1:23: E-PARSE"),
        ("| fields a, a", "1:13: E-TYPE"), ("1 in [1]", "1:3: E-PARSE"), ("x in []", "1:7: E-PARSE"), ("x == 'a", "1:6: E-PARSE"), ("x == 'a\\q'", "1:6: E-PARSE"),
        ("日本 == ", "1:7: E-PARSE"), ("x == 1\n  and", "2:6: E-PARSE"), ("| stats sum(a.b), sum(a_b)", "1:19: E-TYPE"), ("(" * 101 + "x == 1" + ")" * 101, "1:101: E-PARSE: more than 100"),
        ("count == 5", "1:1: E-PARSE"),
    ],
)
def test_errors_are_positioned(text, start):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert str(e.value).startswith(start)


def test_suggestions():
    with pytest.raises(QueryError, match="did you mean 'stats'"):
        parse("| stat count()")
    with pytest.raises(QueryError, match="did you mean 'p95'"):
        parse("| stats p95x(a)")
    assert suggest("sort", ["short", "sore"]) is None and suggest("zzz", ["limit"]) is None
    with pytest.raises(QueryError, match="^1:8193: E-PARSE: the query goes on"):
        parse("x" * 9000)
    with pytest.raises(QueryError, match="^3:2: E-PARSE"):
        parse("a ==\n1 or\nb == 2", max_query=11)


def test_durations():
    assert durations.parse("1h30m") == 5_400_000_000 and durations.parse("-1.5s") == -1_500_000 and durations.parse("500ns") == 0
    assert [durations.parse(t) for t in ("", "1", "1d", "h", "1h2", "-")] == [None] * 6


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.=!<>~|,()[]'\"\\ 01h-+\nstcountbyé", max_size=40))
def test_any_text_parses_or_fails_with_a_position(text):
    try:
        parse(text)
    except QueryError as e:
        assert e.position.line >= 1 and e.position.col >= 1


def test_everything_imports_without_a_session():
    """In a process of its own, where no session runs."""
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    queries, sql = map(int, said.stdout.split())
    assert queries >= sql > 60
