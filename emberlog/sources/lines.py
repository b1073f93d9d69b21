"""Lines of files with the order in which they arrived, decoded to VARIANT rows."""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import times
from emberlog.functions.text import let
from emberlog.functions.values import STRING, Resolver, Variant, _get, column
from emberlog.operators.rows import Rows
from emberlog.sources.shared import shared_folder

MAX_LINE, MAX_DEPTH = 1 << 20, 32
SAMPLE = 64
#: Bytes of a file that tell its format; files that a scan in order reads one by one.
HEAD, SCANS = 1 << 20, 256
FORMATS = ("auto", "jsonl", "logfmt", "plain")
_SENTINEL = "\\u0001emberlog"
#: One whole logfmt line, and one pair of it.
PAIR = r"""[A-Za-z0-9_\-./]+=(?:"(?:[^"\\]|\\["\\nt])*"|[^" ][^ ]*|)"""
LOGFMT = rf"^ *(?:{PAIR}(?: +{PAIR})*)? *\z"


@dataclass(frozen=True)
class Options:
    format: str = "auto"
    max_line: int = MAX_LINE
    max_depth: int = MAX_DEPTH
    tz: str = "UTC"
    time: bool = True  # whether rows get their timestamps


class InputError(Exception):
    """A file that can't be read."""


@dataclass(frozen=True)
class Lines:
    """Decoded rows, and all lines (__line, __seq, __v and marks) they come from."""

    rows: Rows
    all: DataFrame

    @property
    def bad(self) -> DataFrame:
        """The lines that were not decoded."""
        return self.all.filter(F.col("__malformed") | F.col("__oversized"))

    def metrics(self, within: Column | None = None) -> list[Column]:
        """What counters count. within: the rows that bounds of time keep."""
        present = F.exists(F.array(*[_candidate(c).source.isNotNull() for c in times.CANDIDATES]), lambda p: p)
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        row = F.col("__v").isNotNull()
        return [
            count(~F.col("__oversized") & ~F.col("__empty")).alias("lines"), count(F.col("__malformed")).alias("malformed"), count(F.col("__oversized")).alias("oversized"), count(F.col("__empty")).alias("empty"),
            count(F.col("__dup")).alias("dup_keys"), count(row & F.col("__ts").isNull() & present).alias("ts_unparsed"),
            count(row & ~F.coalesce(within, F.lit(False)) if within is not None else F.lit(0)).alias("window_dropped"),
        ]

    def counters(self, within: Column | None = None) -> DataFrame:
        """A row of counters, which takes a pass of its own."""
        return self.all.agg(*self.metrics(within))

    def observed(self, observation: Observation, within: Column | None = None) -> Rows:
        """The rows, whose first complete pass brings the counters along."""
        return replace(self.rows, df=_good(self.all.observe(observation, *self.metrics(within))))


@dataclass(frozen=True)
class File:
    """A file in any store that Spark reads: what Spark calls it, its name in _metadata, and its first bytes, uncompressed."""

    path: str
    name: str
    head: bytes
    packed: bool


def _head(start: bytes) -> bytes:
    """The content of a file's first bytes; whole lines, where the file has more than these."""
    out = start
    if start[:2] == b"\x1f\x8b":
        out, left = b"", start
        try:
            while left[:2] == b"\x1f\x8b" and len(out) < HEAD:  # members follow one another
                z = zlib.decompressobj(31)
                out += z.decompress(left, HEAD)
                left = z.unused_data
        except zlib.error:  # what can't be unpacked is an error of the read that follows
            pass
    return out[: out.rfind(b"\n") + 1] if len(start) >= HEAD and b"\n" in out else out


def local_head(path: str) -> bytes:
    with open(path, "rb") as f:
        return _head(f.read(HEAD))


def find(spark: SparkSession, paths: list[str], heads: bool = True) -> list[File]:
    """The files of paths in order: a file, all files of a folder by name, or those that a pattern matches. Looks at stores through Hadoop."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: list[File] = []
    for given in paths:
        plain = "://" not in given
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.io.File(os.path.abspath(given)).toURI() if plain else jvm.org.apache.hadoop.fs.Path(given).toUri())
        system = path.getFileSystem(conf)
        try:
            if system.exists(path):
                found = list(system.listStatus(path)) if system.getFileStatus(path).isDirectory() else [system.getFileStatus(path)]
            else:
                found = list(system.globStatus(path) or []) if any(c in given for c in "*?[{") else []
        except Py4JJavaError as e:
            raise InputError(f"open {given}: {e.java_exception.getMessage()}") from None
        files = sorted((f.getPath() for f in found if f.isFile() and (len(found) == 1 or f.getPath().getName()[0] not in "._")), key=lambda f: f.getName())
        if not files:
            raise InputError(f"open {given}: no such file")
        for f in files:
            start = b""
            if heads:
                stream = system.open(f)
                start = bytes(stream.readNBytes(HEAD))
                stream.close()
            out.append(File(re.sub(r"([\[\]{}*?\\])", r"\\\1", f.toString()), _name(f.toUri().toString()), _head(start), start[:2] == b"\x1f\x8b"))
    return out


def _name(uri: str) -> str:
    return re.sub("^([A-Za-z0-9+.-]+):/+", r"\1:/", uri)


def detect(head: bytes) -> str:
    """Format of a file's first lines that aren't empty: JSON objects, logfmt pairs, or plain text."""
    import json

    text = head.decode("utf-8", "replace").removeprefix("﻿")
    lines = [x for x in (y.removesuffix("\r") for y in text.split("\n")) if x][:SAMPLE]

    def is_json(x: str) -> bool:
        try:
            return isinstance(json.loads(x, parse_constant=lambda _: 1 / 0), dict)
        except (ValueError, ZeroDivisionError, RecursionError):
            return False

    if lines and all(map(is_json, lines)):
        return "jsonl"
    pattern = re.compile(LOGFMT.replace(r"\z", r"\Z"))
    if lines and all(pattern.match(x) and "=" in x for x in lines):
        return "logfmt"
    return "plain"


def read(spark: SparkSession, paths: list[str], options: Options = Options(), in_order: bool = False) -> Lines:
    """Rows of files in the order of paths, then of lines.

    Files of one format are one scan, whose rows find their file's place by its name. in_order: a scan for each file, so that partitions
    follow one another as the lines do; for files up to SCANS.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    files = find(spark, paths)
    files = [_renamed(spark, f) if f.packed and not f.path.endswith(".gz") else f for f in files]
    kinds = [options.format if options.format != "auto" else detect(f.head) for f in files]
    parts: list[tuple[DataFrame, str]] = []
    alike: dict[str, dict[str, int]] = {}  # places of files by name and format
    in_order = in_order and len(files) <= SCANS
    for number, (f, kind) in enumerate(zip(files, kinds)):
        if in_order or f.name in alike.get(kind, {}):
            parts.append((_text(spark, [f.path], F.lit(number)), kind))
        else:
            alike.setdefault(kind, {})[f.name] = number
    for kind, numbers in alike.items():
        own = [files[n].path for n in numbers.values()]
        if len(own) == 1:
            parts.append((_text(spark, own, F.lit(next(iter(numbers.values())))), kind))
            continue
        places = spark.createDataFrame(list(numbers.items()), "__name string, __file int")
        parts.append((_text(spark, own, F.col("__file"), places), kind))
    out = _decoded(parts, options)
    return replace(out, rows=replace(out.rows, notes={"in_order": True})) if in_order else out


def from_lines(df: DataFrame, line: str, order: str, options: Options) -> Lines:
    """Rows of a table that has lines in a column and their order in another."""
    lines = df.select(F.col(line).alias("__line"), F.struct(F.lit(0).alias("file"), F.lit(0).cast("long").alias("block"), F.col(order).cast("long").alias("id")).alias("__seq"))
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return _decoded([(lines, options.format)], options)


def _text(spark: SparkSession, paths: list[str], ordinal: Column, places: DataFrame | None = None) -> DataFrame:
    """Lines of files; ordinal: the file's place among all, by its name in places."""
    lines = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("path"))
    if places is not None:
        # sent to the lines: dealt out by their file's name, all lines of a file would go to one task
        lines = lines.join(F.broadcast(places), F.regexp_replace("path", "^([A-Za-z0-9+.-]+):/+", "$1:/") == F.col("__name"))
    return lines.select(F.col("value").alias("__line"), F.struct(ordinal.alias("file"), "block", "id").alias("__seq"))


def _renamed(spark: SparkSession, file: File) -> File:
    """A copy, in the shared folder, of a gzip file whose name hides that it is one; Spark goes by names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(re.sub(r"\\(.)", r"\1", file.path))
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark, 'unpacked')}/{source.getName()}.gz")
    system = target.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, system, target, False, conf)
    system.deleteOnExit(target.getParent())
    target = system.makeQualified(target)
    return replace(file, path=re.sub(r"([\[\]{}*?\\])", r"\\\1", target.toString()), name=_name(target.toUri().toString()))


def readable(path: str) -> bool:
    return os.path.isfile(path)


def _with_values(df: DataFrame, kind: str, options: Options) -> DataFrame:
    """Lines (__line, __seq) with their values (__v, null if malformed) and what counters need."""
    first = (F.col("__seq.block") == 0) & F.col("__line").startswith("﻿")
    df = df.withColumn("__oversized", F.octet_length("__line") > options.max_line)
    line = F.when(first, F.substr("__line", F.lit(2))).otherwise(F.col("__line"))
    df = df.withColumn("__line", F.when(line.endswith("\r"), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line))
    df = df.withColumn("__empty", ~F.col("__oversized") & (F.col("__line") == ""))
    value = F.when(~F.col("__oversized") & ~F.col("__empty"), decode(F.col("__line"), kind, options.max_depth))
    # through a generator, which filters stay above: a line is decoded once however often a query looks at it
    df = df.select("*", F.explode(F.array(value)).alias("__v"))
    # keys of all levels, in the line and in what it was parsed to; as many colons in both tell quickly that none went
    again = F.to_json("__v")
    keys = lambda text: F.regexp_count(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '"'), F.lit(r'"\s*:'))
    colons = lambda text: F.length(text) - F.length(F.translate(text, ":", ""))
    plain = (colons(F.col("__line")) == colons(again)) & ~F.contains(F.col("__line"), F.lit("\\u003"))
    dup = F.when(F.col("__v").isNull() | plain, F.lit(0)).otherwise(keys(F.col("__line")) - keys(again)) if kind == "jsonl" else F.lit(0)
    return df.withColumn("__dup", dup).withColumn("__malformed", ~F.col("__oversized") & ~F.col("__empty") & F.col("__v").isNull())


def _with_time(df: DataFrame, options: Options) -> DataFrame:
    if not options.time:
        return df.withColumn("__ts", F.lit(None).cast("long"))
    candidates = F.array(*[F.struct(_string(v).alias("text"), v.integer().alias("whole")) for v in map(_candidate, times.CANDIDATES)])
    found = F.transform(candidates, lambda c: F.coalesce(times.parsed(c["text"], options.tz), times.epoch(c["whole"])))
    return df.withColumn("__ts", F.get(F.array_compact(found), F.lit(0)))


def _good(df: DataFrame) -> DataFrame:
    return df.filter(F.col("__v").isNotNull())


def _rows(df: DataFrame, options: Options) -> Rows:
    return Rows(_good(df), Resolver({}, "__v", "null", options.tz, ts="__ts"), ("__v",), ("__v",), ("__seq",), "__line")


def decoded_rows(df: DataFrame, kind: str, options: Options) -> Rows:
    """Rows of lines (__line, __seq) of one format."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return _rows(_with_time(_with_values(df, kind, options), options), options)


def _decoded(parts: list[tuple[DataFrame, str]], options: Options) -> Lines:
    runs: list[tuple[DataFrame, str]] = []  # files of one format that follow one another are decoded by one expression
    for df, kind in parts:
        if runs and runs[-1][1] == kind:
            runs[-1] = (runs[-1][0].unionByName(df), kind)
        else:
            runs.append((df, kind))
    good = None
    for df, kind in runs:
        df = _with_values(df, kind, options)
        good = df if good is None else good.unionByName(df)
    good = _with_time(good, options)
    return Lines(_rows(good, options), good)


def _candidate(name: str) -> Variant:
    return Variant(_get(F.col("__v"), [name]))


def _string(value: Variant) -> Column:
    return F.when(column(value.has(STRING)), value.string())


def decode(line: Column, kind: str, max_depth: int = MAX_DEPTH) -> Column:
    """A line as a VARIANT object; null if it is malformed."""
    if kind == "plain":
        return F.to_variant_object(F.struct(line.alias("msg")))
    return _json(line, max_depth) if kind == "jsonl" else _logfmt(line)


def _json(line: Column, max_depth: int) -> Column:
    """One object and nothing else. The parser ignores what follows a value, so the line is parsed as the first element of an array whose
    second one is known."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{_SENTINEL}"]')))

    def checked(array: Column) -> Column:
        second = F.try_variant_get(array, "$[1]", "string") == "\x01emberlog"
        alone = F.try_variant_get(array, "$[2]", "variant").isNull()
        return let(F.try_variant_get(array, "$[0]", "variant"), lambda first: F.when(second & alone & F.schema_of_variant(first).startswith("OBJECT"), first))

    openers = F.length(line) - F.length(F.translate(line, "{[", ""))  # in strings too: a bound that is quick to tell
    brackets = F.regexp_replace(F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    depth = F.aggregate(
        F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")),
        lambda a: a["most"],
    )
    shallow = (openers <= max_depth) | (depth <= max_depth)
    return F.when(shallow, let(wrapped, checked))


def _logfmt(line: Column) -> Column:
    """Pairs of a line; the last of equal keys counts. A line of spaces is a row without fields."""
    pairs = F.regexp_extract_all(line, F.lit(f"({PAIR})"), F.lit(1))
    raw = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([^=]+)=", 1).alias("key"), F.regexp_replace(p, r"^[^=]+=", "").alias("value")))

    def value(x: Column) -> Column:
        inner = F.substr(x, F.lit(2), F.length(x) - 2)
        mark = "\x00"
        plain = F.replace(F.replace(F.replace(F.replace(F.replace(inner, F.lit("\\\\"), F.lit(mark)), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit(mark), F.lit("\\"))
        return F.when(x.startswith('"'), plain).otherwise(x)

    n = F.size(raw)
    last = F.filter(raw, lambda p, k: ~F.exists(F.slice(raw, k + 2, F.greatest(n - k - 1, F.lit(0))), lambda later: later["key"] == p["key"]))
    made = F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], value(p["value"]))))
    empty = F.try_parse_json(F.lit("{}"))
    return F.when(line.rlike(LOGFMT), F.when(n > 0, F.to_variant_object(made)).otherwise(empty))



