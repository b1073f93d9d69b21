"""Command line: emberlog 'QUERY' [FILE...]."""

from __future__ import annotations

import argparse
import os
import signal
import sys
import tempfile
import threading
from contextlib import contextmanager
from dataclasses import replace
from typing import BinaryIO, TextIO

from emberlog.plans.errors import QueryError
from emberlog.plans.nodes import Limit, Query, Sort, Stats
from emberlog.plans.parser import MAX_QUERY, parse

OK, USAGE, COMPILE, DATA, IO, INTERRUPTED = 0, 1, 2, 3, 4, 130
VERSION = "0.1.0"


class Usage(Exception):
    pass


class _Arguments(argparse.ArgumentParser):
    def error(self, message: str):
        raise Usage(message)


def arguments() -> argparse.ArgumentParser:
    p = _Arguments(prog="emberlog", add_help=False)
    add = p.add_argument
    add("rest", nargs="*", metavar="QUERY [FILE...]")
    add("-f", "--format", default="auto")
    add("-o", "--output", default="raw")
    add("-tz", "--tz", default="UTC")
    add("-since", "--since")
    add("-until", "--until")
    add("-max-groups", "--max-groups", type=int, default=10_000)
    add("-max-sample", "--max-sample", type=int, default=100_000)
    add("-seed", "--seed", type=int, default=0, help="accepted; percentiles are exact")
    add("-sketch", "--sketch", action="store_true", help="percentiles from a sketch of fixed size")
    add("-levels", "--levels", default="")
    add("-max-depth", "--max-depth", type=int, default=32)
    add("-max-line", "--max-line", type=int, default=1 << 20)
    add("-max-query", "--max-query", type=int, default=MAX_QUERY)
    add("-j", "--workers", type=int, default=0, help="shuffle partitions; 0: the session's own")
    add("-w", "--watch", nargs="?", type=float, const=1.0, default=None)
    add("-on-error", "--on-error", default="warn")
    add("-C", "--no-color", action="store_true")
    add("-q", "--quiet", action="store_true")
    add("-Q", "--query-file")
    add("-h", "--help", action="store_true")
    add("--version", action="store_true")
    return p


def checked(args: argparse.Namespace) -> None:
    for name, value, known in (("format", args.format, ("auto", "jsonl", "logfmt", "plain")), ("output", args.output, ("raw", "jsonl", "table", "csv")), ("on-error", args.on_error, ("skip", "warn", "stop"))):
        if value not in known:
            raise Usage(f"invalid --{name} {value!r}: want one of {', '.join(known)}")
    for name in ("max_groups", "max_sample", "max_depth", "max_line", "max_query"):
        if getattr(args, name) < 1:
            raise Usage(f"--{name.replace('_', '-')} must be >= 1")
    if args.workers < 0:
        raise Usage("--workers must be >= 1")
    if args.max_line > 16 << 20:
        raise Usage("--max-line must be at most 16MB")
    if args.max_query > 65_536:
        raise Usage("--max-query must be at most 65536")
    if args.watch is not None and args.watch <= 0:
        raise Usage("--watch interval must be positive")


def levels(text: str) -> dict[str, int]:
    out = {}
    for part in filter(None, text.split(",")):
        name, sep, number = part.partition("=")
        try:
            out[name.strip().lower()] = int(number)
        except ValueError:
            sep = ""
        if not sep or not name.strip():
            raise Usage(f"invalid --levels entry {part!r}: want name=NUM")
    return out


def summary(lines: dict[str, int], overflowed: int) -> str | None:
    """The counters in a line, None if there is nothing to say."""
    parts = [(lines.get("malformed", 0), "malformed"), (lines.get("oversized", 0), "oversized"), (lines.get("dup_keys", 0), "dup key(s)"), (lines.get("window_dropped", 0), "dropped by --since/--until"), (lines.get("ts_unparsed", 0), "ts unparsed"), (overflowed, "groups overflowed to (other)")]
    said = [f"{n} {what}" for n, what in parts if n]
    return ", ".join([f"{lines.get('lines', 0)} line(s) read", *said]) if said else None


def main(argv: list[str] | None = None, stdin: BinaryIO | None = None, stdout: BinaryIO | None = None, stderr: TextIO | None = None, spark=None) -> int:
    stdin, stdout, stderr = stdin or sys.stdin.buffer, stdout or sys.stdout.buffer, stderr or sys.stderr
    with _signals():
        return _guarded(argv, stdin, stdout, stderr, spark)


@contextmanager
def _signals():
    """The first SIGINT or SIGTERM ends the run in good order, with what was given out so far; a second one ends the process at once."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return
    came: list[int] = []

    def stop(number, _frame) -> None:
        came.append(number)
        if len(came) > 1:
            os._exit(INTERRUPTED)
        raise KeyboardInterrupt

    before = {n: signal.signal(n, stop) for n in (signal.SIGINT, signal.SIGTERM)}
    try:
        yield
    finally:
        for n, handler in before.items():
            signal.signal(n, handler)


def _guarded(argv, stdin: BinaryIO, stdout: BinaryIO, stderr: TextIO, spark) -> int:
    try:
        return _run(sys.argv[1:] if argv is None else argv, stdin, stdout, stderr, spark)
    except Usage as e:
        print(f"emberlog: {e}", file=stderr)
        return USAGE
    except QueryError as e:
        print(e, file=stderr)
        return COMPILE
    except KeyboardInterrupt:
        stdout.flush()
        print("emberlog: interrupted", file=stderr)
        return INTERRUPTED
    except BrokenPipeError:
        return OK


def _run(argv: list[str], stdin: BinaryIO, stdout: BinaryIO, stderr: TextIO, spark) -> int:
    args = arguments().parse_intermixed_args(_joined(argv))
    if args.help:
        stdout.write(arguments().format_help().encode())
        return OK
    if args.version:
        stdout.write(f"emberlog {VERSION}\n".encode())
        return OK
    checked(args)
    rest = list(args.rest)
    if args.query_file is not None:
        try:
            text = (stdin.read().decode() if args.query_file == "-" else open(args.query_file, encoding="utf-8").read()).strip()
        except OSError as e:
            print(f"emberlog: {e}", file=stderr)
            return IO
    elif rest:
        text = rest.pop(0)
    else:
        raise Usage("no query given")
    if not text.strip():
        raise Usage("empty query")
    query = parse(text, args.max_query)

    from emberlog.engine import Result, Settings, bound, run
    from emberlog.sources import lines as sources

    settings = Settings(args.tz, None, args.since, args.until, levels(args.levels), args.max_groups, args.max_sample, args.max_query, args.sketch)
    for b in (args.since, args.until):
        if b is not None:
            try:
                bound(b, 0)
            except ValueError as e:
                raise Usage(str(e)) from None
    spark = spark or _session(args.workers)

    if query.filter is not None:
        _patterns(query.filter)
    if args.watch is not None:
        from emberlog.streaming.watch import watch

        if not rest or "-" in rest:
            raise Usage("watch mode needs files")
        return watch(spark, query, rest, args, settings, stdout, stderr)
    paths = [_spooled(stdin, spark) if p == "-" else p for p in rest or ["-"]]
    gathers = any(isinstance(s, (Sort, Stats)) for s in query.stages)
    try:
        found = sources.read(spark, paths, sources.Options(args.format, args.max_line, args.max_depth, args.tz), in_order=not gathers)
    except sources.InputError as e:
        print(f"emberlog: {e}", file=stderr)
        return IO
    rows = found.rows
    if args.on_error == "stop":
        first = found.bad.orderBy("__seq").select("__seq", "__line", "__oversized").limit(1).collect()
        if first:
            from pyspark.sql import functions as F

            at = first[0]["__seq"]
            early = rows.where(F.col("__seq") < F.struct(F.lit(at["file"]).alias("file"), F.lit(at["block"]).alias("block"), F.lit(at["id"]).alias("id")))
            if not gathers:
                _emit(Result(query, run(query, early, settings)), args.output, stdout)
            print("emberlog: aborted: --on-error stop", file=stderr)
            print("oversized line" if first[0]["__oversized"] else f"malformed line: {first[0]['__line'][:200]}", file=stderr)
            return DATA
    try:
        counted = args.on_error != "skip" and not args.quiet
        seen = _answer(query, found, settings, args.output, stdout, counted)
    except Exception as e:
        if isinstance(e, (KeyboardInterrupt, BrokenPipeError, QueryError)):
            raise
        said = (str(e).splitlines() or [type(e).__name__])[0][:300]
        print(f"emberlog: read error: {said}" if _is_io(e) else f"emberlog: failed: {said}", file=stderr)
        return IO if _is_io(e) else USAGE
    said = summary(seen, seen.get("overflowed", 0)) if counted else None
    if said:
        color = not args.no_color and not os.environ.get("NO_COLOR") and stderr.isatty()
        code = 31 if seen.get("malformed") or seen.get("oversized") else 33
        print(f"emberlog: \x1b[{code}m{said}\x1b[0m" if color else f"emberlog: {said}", file=stderr)
    return OK


def _answer(query: Query, found, settings, output: str, stdout: BinaryIO, counted: bool) -> dict:
    """Give out a result and return its counters.

    Groups bring the counters along in the pass that makes them. A limit over lines ends the scan when it is reached, so there are no
    counters of all lines; other results take a pass for them.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.sql import Observation

    from emberlog.engine import Result, bounds, run

    seen: dict = {}
    within = bounds(found.rows, settings, settings.context().now)
    if any(isinstance(s, Stats) for s in query.stages):
        observation = Observation()
        rows = found.observed(observation, within) if counted else found.rows
        _emit(Result(query, run(query, rows, settings)), output, stdout, seen=seen)
        if not counted:
            return seen
        try:
            return {**observation.get, **seen}
        except Py4JJavaError:  # a filter that is false for all rows: Spark had no need to read them
            pass
    elif query.stages and isinstance(query.stages[-1], Limit) and found.rows.notes.get("in_order"):
        head = replace(query, stages=query.stages[:-1])
        _emit(Result(query, run(head, found.rows, settings)), output, stdout, first=query.stages[-1].n)
        return seen
    else:
        _emit(Result(query, run(query, found.rows, settings)), output, stdout)
    return found.counters(within).collect()[0].asDict() if counted else seen


def _is_io(error: Exception) -> bool:
    """Whether reading the input failed: an exception of java.io or of unpacking, also as a cause of others."""
    text = str(error)
    return isinstance(error, OSError) or any(x in text for x in ("java.io.", "java.util.zip.", "FAILED_READ_FILE", "java.nio.file."))


def _joined(argv: list[str]) -> list[str]:
    """-w takes a value only as -w=SECONDS."""
    out = []
    for a in argv:
        if a in ("-w", "--watch"):
            out.append("--watch=1")
        elif a.startswith("-w="):
            out.append("--watch=" + a[3:])
        elif a.startswith("-") and len(a) > 2 and a[1] in "0123456789":
            out.append(a)
        else:
            out.append(a)
    return out


def _patterns(node) -> None:
    """Compile all patterns, for errors before any input is read."""
    from emberlog.functions.patterns import translate
    from emberlog.plans.nodes import And, Match, Not, Or

    if isinstance(node, Match):
        translate(node.pattern, node.position)
    elif isinstance(node, (And, Or)):
        _patterns(node.left)
        _patterns(node.right)
    elif isinstance(node, Not):
        _patterns(node.inner)


def _emit(result, output: str, stdout: BinaryIO, first: int | None = None, seen: dict | None = None) -> None:
    from emberlog import render

    for part in render.write(result, output, first, seen):
        stdout.write(part)
    stdout.flush()


def _spooled(stdin: BinaryIO, spark) -> str:
    """Standard input as a file, in the shared folder unless all runs on one machine."""
    with tempfile.NamedTemporaryFile(prefix="emberlog-stdin-", delete=False) as f:
        while block := stdin.read(1 << 20):
            f.write(block)
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return f.name
    shared = spark.conf.get("spark.checkpoint.dir")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{os.path.basename(f.name)}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.copyFromLocalFile(True, spark._jvm.org.apache.hadoop.fs.Path(f.name), target)
    return system.makeQualified(target).toString().replace("file:/", "file:///", 1)


def _session(workers: int):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("emberlog").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    if workers:
        builder = builder.config("spark.sql.shuffle.partitions", str(workers))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


if __name__ == "__main__":
    sys.exit(main())
