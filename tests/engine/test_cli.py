"""Whole runs of the command line: output, messages and exit codes."""

import gzip
import io

import pytest

from emberlog import cli


@pytest.fixture
def run(spark, tmp_path):
    def call(*args, files=None, stdin=b""):
        for name, content in (files or {}).items():
            (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
        argv = [str(tmp_path / a[1:]) if a.startswith("@") else a for a in args]
        out, err = io.BytesIO(), io.StringIO()
        code = cli.main(argv, io.BytesIO(stdin), out, err, spark)
        return code, out.getvalue().decode(), err.getvalue()

    return call


def gauges(*rows):
    """Lines of a tide gauge: station, centimetres, and more pairs."""
    return "".join("{" + ",".join(f'"{k}":{v}' for k, v in r.items()) + "}\n" for r in rows)


QUAY = [dict(station='"quay"', cm=n) for n in (181, 176, 190, 202)]
REEF = [dict(station='"reef"', cm=n) for n in (44, 39.5, 61)]
TIDES = gauges(QUAY[0], REEF[0], QUAY[1], REEF[1], QUAY[2], {"station": '"buoy 7"', "cm": 5}, REEF[2], QUAY[3])

CASES = {
    "a comparison keeps the lines as they are": (["cm > 180", "@i"], '{"cm": 181, "by": "Ada"}\n{ "cm":12 }\n{"at":"quay","cm":180.5}\n{"cm":"high"}\n', '{"cm": 181, "by": "Ada"}\n{"at":"quay","cm":180.5}\n', "", 0),
    "csv with quotes and several kinds": (["-o", "csv", "cm < 50 | fields station, cm, ok", "@i"], gauges({"station": '"reef, \\"outer\\""', "cm": 44, "ok": "true"}, {"station": '"reef"', "cm": 39.5}, QUAY[0]), 'station,cm,ok\r\n"reef, ""outer""",44,true\r\nreef,39.5,\r\n', "", 0),
    "levels by their order": (['severity < "warn"', "@i"], gauges({"severity": '"DEBUG"', "n": 1}, {"severity": '"fatal"', "n": 2}, {"severity": "25", "n": 3}, {"severity": '"nonsense"', "n": 4}), '{"severity":"DEBUG","n":1}\n{"severity":25,"n":3}\n{"severity":"nonsense","n":4}\n', "", 0),
    "levels of one's own": (["--levels", "spring=7,neap=3", 'lvl >= "spring"', "@i"], gauges({"lvl": '"neap"'}, {"lvl": '"Spring"', "cm": 240}, {"lvl": '"trace"'}), '{"lvl":"Spring","cm":240}\n{"lvl":"trace"}\n', "", 0),
    "logfmt with quoted values": (["-f", "logfmt", 'note ~ "calm" and cm < 100', "@i"], 'station=reef cm=44 note="calm, clear"\nstation=quay cm=181 note=calm\nstation=reef cm=61 note=rough\nstation=reef cm=7 note=calm\n', 'station=reef cm=44 note="calm, clear"\nstation=reef cm=7 note=calm\n', "", 0),
    "groups beyond the guard": (["--max-groups", "1", "| stats count(), sum(cm) by station", "@i"], TIDES, '{"station":"quay","count":4,"sum_cm":749}\n{"station":"(other)","count":4,"sum_cm":149.5}\n', "emberlog: 8 line(s) read, 4 groups overflowed to (other)\n", 0),
    "group keys that are null, empty, absent or numbers": (["-o", "jsonl", "| stats count(), max(n) by k", "@i"], '{"n":1}\n{"k":null,"n":2}\n{"k":"","n":3}\n{"k":4,"n":4}\n{"n":5}\n{"k":"4","n":6}\n', '{"k":"","count":1,"max_n":3}\n{"k":null,"count":1,"max_n":2}\n{"count":2,"max_n":5}\n{"k":4,"count":2,"max_n":6}\n', "", 0),
    "nearest ranks": (["| stats p50(cm), p99(cm), count() by station", "@i"], TIDES, '{"station":"buoy 7","p50_cm":5,"p99_cm":5,"count":1}\n{"station":"quay","p50_cm":181,"p99_cm":202,"count":4}\n{"station":"reef","p50_cm":44,"p99_cm":61,"count":3}\n', "", 0),
    "groups sorted by a result": (["| stats avg(cm), count() by station | sort avg_cm asc limit 2 | limit 1", "@i"], TIDES, '{"station":"buoy 7","avg_cm":5,"count":1}\n', "", 0),
    "a table with missing and nested cells": (["-o", "table", "exists(cm) | fields station, cm, gear", "@i"], gauges({"station": '"quay"', "cm": 9, "gear": "[1]"}, {"cm": 12345, "gear": "null"}, {"station": '"r"', "cm": -0.25, "gear": '{"a":1}'}), "station       cm  gear\nquay           9  [array]\n(missing)  12345  (null)\nr          -0.25  [object]\n", "", 0),
    "windows of several timestamp forms": (["-f", "jsonl", "| stats count(), min(n) every 15m", "@i"], gauges({"ts": '"2023-03-05T23:59:59.999+01:00"', "n": 1}, {"timestamp": 1678057200, "n": 2}, {"@timestamp": '"2023-03-05 23:14:00"', "n": 3}, {"time": 1678057199123, "n": 4}, {"n": 5}, {"ts": '"soon"', "n": 6}), '{"window":"(no-ts)","count":2,"min_n":5}\n{"window":"2023-03-05T22:45:00Z","count":2,"min_n":1}\n{"window":"2023-03-05T23:00:00Z","count":2,"min_n":2}\n', "emberlog: 6 line(s) read, 1 ts unparsed\n", 0),
    "values of several kinds in one field": (["| stats count(), sum(v), avg(v), min(v), max(v), count_distinct(v) by g", "@i"], gauges({"g": '"mixed"', "v": '"b"'}, {"g": '"mixed"', "v": 10}, {"g": '"mixed"', "v": '"a"'}, {"g": '"flags"', "v": "false"}, {"g": '"flags"', "v": "true"}, {"g": '"flags"', "v": "true"}, {"g": '"none"'}), '{"g":"flags","count":3,"sum_v":0,"avg_v":"(none)","min_v":false,"max_v":true,"count_distinct_v":2}\n{"g":"mixed","count":3,"sum_v":10,"avg_v":10,"min_v":"a","max_v":"b","count_distinct_v":3}\n{"g":"none","count":1,"sum_v":0,"avg_v":"(none)","min_v":"(none)","max_v":"(none)","count_distinct_v":0}\n', "", 0),
    "paths into containers": (["exists(hull.plates[1]) | fields hull.plates[1], hull.name | limit 2", "@i"], gauges({"hull": '{"plates":[3,[4.50,"<&>"]],"name":"Wren"}'}, {"hull": '{"plates":[3]}'}, {"hull": '{"plates":[0,null]}'}, {"hull": '{"plates":[1,2]}'}), '{"hull.plates[1]":[4.5,"\\u003c\\u0026\\u003e"],"hull.name":"Wren"}\n{"hull.plates[1]":null}\n', "", 0),
    "stopping at the first bad line": (["-f", "jsonl", "--on-error", "stop", "cm > 0", "@i"], '{"cm":3}\n{"cm":-3}\n{"cm":4}\n{"cm":\n{"cm":5}\n', '{"cm":3}\n{"cm":4}\n', 'emberlog: aborted: --on-error stop\nmalformed line: {"cm":\n', 3),
    "what the counters count": (["-f", "jsonl", "exists(cm)", "@i"], '{"cm":1}{"cm":2}\n\r\n"cm"\n{"cm":7,"cm":8,"cm":9}\n{"cm":0,"time":[]}\n{"cm":' + '{"d":' * 32 + "1" + "}" * 32 + "}\n\n", '{"cm":7,"cm":8,"cm":9}\n{"cm":0,"time":[]}\n', "emberlog: 5 line(s) read, 3 malformed, 2 dup key(s), 1 ts unparsed\n", 0),
    "lines that are too long": (["-f", "plain", "--max-line", "9", 'msg ~ "tide"', "@i"], "high tide\nspring tide\ntide", "high tide\ntide\n", "emberlog: 2 line(s) read, 1 oversized\n", 0),
    "bounds of time": (["--since", "2023-03-05T12:00:00+02:00", "--until", "2023-03-06T00:00:00Z", "exists(n)", "@i"], gauges({"n": 1, "ts": 1678010400}, {"n": 2, "ts": 1678010399}, {"n": 3, "ts": '"2023-03-06T00:00:00Z"'}, {"n": 4, "ts": '"2023-03-07"'}, {"n": 5}), '{"n":1,"ts":1678010400}\n{"n":3,"ts":"2023-03-06T00:00:00Z"}\n', "emberlog: 5 line(s) read, 3 dropped by --since/--until, 1 ts unparsed\n", 0),
}


@pytest.mark.parametrize("name", CASES)
def test_runs(run, name):
    args, content, stdout, stderr, code = CASES[name]
    assert run(*args, files={"i": content}) == (code, stdout, stderr)


def test_gzip_with_and_without_its_name(run):
    packed = gzip.compress(b'{"cm":44}\n{"mm":') + gzip.compress(b'1}\n{"cm":"\xc3\xa9"}\n') + gzip.compress(b'{"cm":3}')
    for name in ("tides.json.gz", "tides.dump"):
        assert run("exists(cm)", f"@{name}", files={name: packed}) == (0, '{"cm":44}\n{"cm":"é"}\n{"cm":3}\n', "")


def test_stdin_and_files_in_order(run):
    files = {"z": '{"cm":9}\n{"cm":8}\n', "a": '{"cm":6}\n{"cm":5}\n'}
    assert run("| limit 4", "@z", "-", "@a", files=files, stdin=b'{"cm":7}\n')[1] == "".join(f'{{"cm":{n}}}\n' for n in (9, 8, 7, 6))


@pytest.mark.parametrize(
    ("args", "code", "said"),
    [(["--format=xml", "cm > 1"], 1, "invalid --format"), (["  "], 1, "empty query"), (["cm >\n"], 2, "2:1: E-PARSE"), (['note ~ "[a"'], 2, "E-TYPE"), (["cm > 1", "@lost"], 4, "no such file"), (["--max-sample", "0", "cm > 1"], 1, "max-sample"), (["--levels", "spring", "cm > 1"], 1, "levels"), (["--until", "noon", "cm > 1"], 1, "time bound")],
)
def test_errors(run, args, code, said):
    got = run(*args)
    assert got[0] == code and said in got[2] and got[1] == ""


def test_query_from_a_file(run):
    assert run("-Q", "@q", "@i", files={"q": "\n cm >= 61\n and cm < 190 \n", "i": TIDES}) == (0, gauges(QUAY[0], QUAY[1], REEF[2]), "")


def test_folders_patterns_and_stores(run, tmp_path):
    (tmp_path / "day one").mkdir()
    for name, rows in (("b [x].log", QUAY[:2]), ("a.log", REEF[:1]), (".hidden", QUAY), ("_SUCCESS", QUAY), ("z.bin", QUAY[3:])):
        body = gauges(*rows).encode()
        (tmp_path / "day one" / name).write_bytes(gzip.compress(body) if name == "z.bin" else body)
    want = gauges(REEF[0], *QUAY[:2], QUAY[3])
    assert run("exists(cm)", "@day one") == (0, want, "")
    assert run("exists(cm)", f"file://{tmp_path}/day one/") == (0, want, "")
    assert run("exists(cm)", "@day one/*.log")[1] == gauges(REEF[0], *QUAY[:2])
    assert run("| stats count(), max(cm)", "@day one")[1] == '{"count":4,"max_cm":202}\n'
    assert run("| sort cm desc limit 3", "@day one", "@day one/a.log")[1] == gauges(QUAY[3], QUAY[0], QUAY[1])
    assert run("exists(cm)", "@day two/*.log")[0] == 4


def test_repeated_keys_of_all_levels(run):
    lines = '{"a":{"b":1,"b":2},"c":[{"d":1},{"d":1,"d":3}]}\n{"a":"\\"x\\":","b":",\\"b\\":"}\n{"a":1,"a":{"b":1}}\n{"e" : 1 , "f":[":","x",":"]}\n'
    assert run("-f", "jsonl", "exists(a) or exists(e) | stats count()", "@i", files={"i": lines}) == (0, '{"count":4}\n', "emberlog: 4 line(s) read, 3 dup key(s)\n")


def test_a_limit_reads_no_further_than_it_must(run, spark, tmp_path):
    """Files behind the one that has enough rows aren't opened: here they can't be read at all."""
    body = gauges(*[dict(cm=n) for n in range(50)])
    broken = gzip.compress(body.encode())[:-30]
    for k in range(8):
        (tmp_path / f"f{k}.gz").write_bytes(gzip.compress(body.encode()) if k == 0 else broken)
    files = [f"@f{k}.gz" for k in range(8)]
    assert run("-f", "jsonl", "cm >= 7 | limit 3", *files) == (0, gauges(*[dict(cm=n) for n in (7, 8, 9)]), "")
    code, _, said = run("-f", "jsonl", "cm >= 7 | stats count()", *files)
    assert code == 4 and said.startswith("emberlog: read error")


def test_counters_come_with_the_groups(run, spark, tmp_path):
    """No pass over the lines beside the one that makes the groups."""
    (tmp_path / "i").write_text(TIDES + "broken\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    assert run("-f", "jsonl", "--since", "2020-01-01T00:00:00Z", "| stats count() by station", "@i") == (0, "", "emberlog: 9 line(s) read, 1 malformed, 8 dropped by --since/--until\n")
    stages = {s for j in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("", "")
    assert sum(1 for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks) <= 6


def test_results_as_folders(spark, tmp_path):
    from emberlog import render
    from emberlog.engine import Engine

    (tmp_path / "i").write_text(TIDES)
    found = Engine(spark).files("cm > 100 | fields station, cm", [str(tmp_path / "i")])
    render.save(found, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(gauges(*QUAY).splitlines())
    render.save(Engine(spark).files("| stats count() by station", [str(tmp_path / "i")]), str(tmp_path / "csv"), "csv")
    assert sorted(tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()) == [("buoy 7", "1"), ("quay", "4"), ("reef", "3")]


def test_filters_that_no_row_can_pass(run):
    for query, out in (("1 == 2 | stats count()", '{"count":0}\n'), ("1 == 2 | stats count() by station", ""), ("1 == 2", "")):
        assert run("-f", "jsonl", query, "@i", files={"i": TIDES + "broken\n"}) == (0, out, "emberlog: 9 line(s) read, 1 malformed\n")
