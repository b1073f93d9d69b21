import argparse
import io
import os
import time

import pytest

from emberlog.engine import Settings
from emberlog.plans.parser import parse
from emberlog.sources.lines import Options
from emberlog.streaming.tail import TailReader, advance, tail
from emberlog.streaming.watch import snapshots
from emberlog import render


def test_offsets_follow_appends_and_rotation(tmp_path):
    p = str(tmp_path / "a.log")
    assert advance(p, None, True) == ([], None)
    with open(p, "wb") as f:
        f.write(b"one\ntwo")
    lines, at = advance(p, None, True)
    assert [x for x, _ in lines] == [b"one"]
    with open(p, "ab") as f:
        f.write(b"!\nthree\n")
    lines, at = advance(p, at, True)
    assert lines == [(b"two!", 4), (b"three", 9)]
    with open(p, "wb") as f:  # shrinks
        f.write(b"x\n")
    lines, at = advance(p, at, True)
    assert lines == [(b"x", 0)]
    os.remove(p)
    lines, at = advance(p, at, True)
    assert lines == []
    with open(p, "wb") as f:  # comes back
        f.write(b"y\nz\n")
    assert [x for x, _ in advance(p, at, True)[0]] == [b"y", b"z"]


def test_first_poll_skips_what_is_there_and_rereads(tmp_path):
    p = tmp_path / "a.log"
    p.write_text("old\n")
    reader = TailReader([str(p), str(tmp_path / "later")], False)
    start = reader.initialOffset()
    with p.open("a") as f:
        f.write("new\n")
    (tmp_path / "later").write_text("first\n")
    rows, end = reader.read(start)
    rows = list(rows)
    assert [r[:2] for r in rows] == [("new", 0), ("first", 1)]
    with p.open("a") as f:
        f.write("after\n")
    assert list(reader.readBetweenOffsets(start, end)) == rows


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("| stats count(), count_distinct(x) by k | sort count desc limit 1", '{"k":"b","count":2,"count_distinct_x":2}\n'),
        ("x > 1", '{"k":"b","x":2}\n{"k":"b","x":3}\n'),
        ("exists(x) | sort x desc limit 2", '{"k":"b","x":3}\n{"k":"b","x":2}\n'),
    ],
)
def test_snapshots(spark, tmp_path, query, want):
    p = tmp_path / "a.log"
    p.write_text('{"k":"a","x":1}\n{"k":"b","x":2}\nbroken\n{"k":"b","x":3}\n')
    seen = []
    running = snapshots(tail(spark, [str(p)], True), parse(query), Settings(), Options("jsonl"), lambda r: seen.append(b"".join(render.write(r, "jsonl")).decode()), 0.2, str(tmp_path / "state"))
    try:
        running.processAllAvailable()
        assert seen[-1] == want
        if "stats" in query:
            with p.open("a") as f:
                f.write('{"k":"a"}\n{"k":"a"}\n{"k":"a"}\n')
            end = time.time() + 30
            while len(seen) < 2 and time.time() < end:
                time.sleep(0.2)
            assert seen[-1] == '{"k":"a","count":4,"count_distinct_x":1}\n'
    finally:
        running.stop()


def test_watch_command_stops(spark, tmp_path):
    from emberlog.streaming.watch import watch

    p = tmp_path / "a.log"
    p.write_text('{"k":"a"}\n')
    args = argparse.Namespace(format="auto", max_line=1 << 20, max_depth=32, quiet=False, output="raw", watch=0.2)
    out, err = io.BytesIO(), io.StringIO()
    assert watch(spark, parse("| stats count() by k"), [str(p)], args, Settings(), out, err, from_start=True, stop_after=8) == 130
    assert out.getvalue().startswith(b'{"k":"a","count":1}\n') and "SNAPSHOT" in err.getvalue()
