"""Results as text: original lines, JSON lines, an aligned table, or CSV. Runs on the driver over an iterator of rows."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.engine import Result
from emberlog.functions import times
from emberlog.functions.text import number_text
from emberlog.functions.values import quoted

#: Rows that the columns of tables and CSV are taken from, and the longest cell of a table.
SAMPLE, WIDEST = 1000, 40
NONE, EMPTY_SET = "(none)", "∅"


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"


MISSING = _Missing()


def to_json(value: object) -> str:
    """JSON text without spaces; <, > and & are escaped in strings."""
    if value is None or value is MISSING:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, (list, tuple)):
        return f"[{','.join(map(to_json, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{to_json(str(k))}:{to_json(v)}" for k, v in value.items() if v is not MISSING) + "}"
    text = json.dumps(str(value), ensure_ascii=False)
    return re.sub("[<>&\u2028\u2029]", lambda m: f"\\u{ord(m[0]):04x}", text.replace("\\b", "\\u0008").replace("\\f", "\\u000c"))


def cell(value: object) -> str:
    """Text of a value in a table."""
    if value is MISSING:
        return "(missing)"
    if value is None:
        return "(null)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(value)
    return "[array]" if isinstance(value, (list, tuple)) else "[object]" if isinstance(value, dict) else str(value)


def decoded(line: str) -> dict:
    """Fields of a line in their order: a JSON object, logfmt pairs, or plain text."""
    try:
        found = json.loads(line)
        if isinstance(found, dict):
            return found
    except ValueError:
        pass
    from emberlog.sources.lines import LOGFMT, PAIR

    if "=" in line and re.match(LOGFMT.replace(r"\z", r"\Z"), line):
        out = {}
        for pair in re.findall(PAIR, line):
            key, _, value = pair.partition("=")
            if value.startswith('"'):
                value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1])
            out[key] = value
        return out
    return {"msg": line}


def _shown(name: str, kind: T.DataType) -> Column:
    source = F.col(quoted(name))
    if isinstance(kind, T.VariantType):
        return F.to_json(source)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return times.label(times.column_micros(source, kind, "UTC"), "UTC")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(source)
    return source.cast("string") if isinstance(kind, (T.DateType, T.BinaryType, T.DecimalType)) else source


def _fetched(result: Result, columns: list, first: int | None) -> Iterator:
    """Rows in their order. first: only so many, from a scan in order, which ends as soon as it has them."""
    rows = result.rows
    if first is not None:
        return iter(rows.df.select(*columns).take(first))
    if "overflowed" in rows.notes:  # groups, which the guard bounds
        return iter(rows.df.select(*columns).collect()) if rows.notes["overflowed"] is not None else rows.df.select(*columns).toLocalIterator()
    if rows.sorted_by or not rows.arrival:
        return rows.df.select(*columns).toLocalIterator()
    if not rows.notes.get("in_order"):
        return rows.df.orderBy(*rows.order).select(*columns).toLocalIterator()
    # partitions follow one another already: all are worked on at once, and handed over one by one
    parts = max(1, rows.df._jdf.queryExecution().toRdd().getNumPartitions())
    whole = rows.df.select(*columns, *[c.alias(f"__at{k}") for k, c in enumerate(rows.order)], F.spark_partition_id().alias("__part"))
    dealt = whole.repartitionById(parts, F.col("__part")).sortWithinPartitions(*[f"__at{k}" for k in range(len(rows.order))])
    return dealt.toLocalIterator(prefetchPartitions=True)


def records(result: Result, first: int | None = None, seen: dict | None = None) -> Iterator[dict]:
    """Rows as ordered dicts in their order; fields that are missing are left out. seen: gets the number of rows in groups beyond the guard."""
    rows = result.rows
    if rows.columns == ("__v",):
        for r in _fetched(result, [F.col("__line")], first):
            yield decoded(r[0])
        return
    schema = rows.df.schema
    places = dict(zip(rows.columns, rows.inner))
    kinds = {name: schema[c].dataType for name, c in places.items()}
    hidden = [c for c in rows.df.columns if c.startswith(("__code_", "__note", "__is_other", "__n"))]
    notes, functions = rows.notes.get("columns", {}), rows.notes.get("functions", {})
    for r in _fetched(result, [*[_shown(places[c], k).alias(places[c]) for c, k in kinds.items()], *hidden], first):
        out = {}
        other = "__is_other" in hidden and r["__is_other"]
        if other and seen is not None:
            seen["overflowed"] = r["__n"]
        for c, kind in kinds.items():
            value: object = r[places[c]]
            if c in functions:
                value = _result(functions[c], value, r[notes[c]], other)
            elif c in rows.codes:
                value = value if other else _by_code(value, r[rows.codes[c]])
            elif value is None:
                value = MISSING if rows.resolver.null_as == "missing" or isinstance(kind, T.VariantType) else None
            elif isinstance(kind, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
                value = json.loads(value)
            if value is not MISSING:
                out[c] = value
        yield out


def _by_code(value: object, code: str) -> object:
    if code in "mz":
        return MISSING if code == "m" else None
    if isinstance(value, str) and code in "nbc":
        return json.loads(value) if code == "c" else value == "true" if code == "b" else _number(value)
    return value


def _number(text: str) -> int | float:
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)


def _result(function: str, value: object, note: str, other: bool) -> object:
    if function == "count_distinct":
        return EMPTY_SET if other else value
    if value is None:
        return _number(note) if function == "sum" and note not in ("i", "f") else NONE
    if function in ("min", "max"):
        return value == "true" if note == "b" and isinstance(value, str) else _number(value) if note == "n" else value
    if note == "a":
        return number_text(int(value) if float(value).is_integer() else float(value)) + "*"
    return int(value) if note in ("i", "v") and float(value).is_integer() else value


def raw(result: Result, first: int | None = None) -> Iterator[bytes]:
    """Original lines."""
    for r in _fetched(result, [F.col("__line").cast("binary").alias("line")], first):
        yield bytes(r[0]) + b"\n"


def jsonl(found: Iterable[dict]) -> Iterator[str]:
    for r in found:
        yield to_json(r) + "\n"


def _columns(found: list[dict]) -> list[str]:
    return list(dict.fromkeys(k for r in found[:SAMPLE] for k in r))


def table(found: Iterable[dict]) -> str:
    """Columns aligned, numbers to the right."""
    rows = list(found)
    columns = _columns(rows)
    numeric = {c: all(isinstance(r[c], (int, float)) and not isinstance(r[c], bool) for r in rows[:SAMPLE] if c in r) for c in columns}
    cells = [columns] + [[x if len(x) <= WIDEST else x[: WIDEST - 1] + "…" for x in (cell(r.get(c, MISSING)) for c in columns)] for r in rows]
    widths = [max(len(row[k]) for row in cells) for k in range(len(columns))]
    out = []
    for row in cells:
        texts = [x.rjust(w) if numeric[c] else x.ljust(w) for x, w, c in zip(row, widths, columns)]
        if texts and not numeric[columns[-1]]:
            texts[-1] = row[-1]
        out.append("  ".join(texts) + "\n")
    return "".join(out)


def csv_text(found: Iterable[dict]) -> str:
    rows = list(found)
    columns = _columns(rows)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    if not columns:
        return "\r\n"
    writer.writerow(columns)
    for r in rows:
        writer.writerow(["" if r.get(c, MISSING) in (None, MISSING) else cell(r[c]) for c in columns])
    return out.getvalue()


def write(result: Result, output: str, first: int | None = None, seen: dict | None = None) -> Iterator[bytes]:
    """Bytes of a result; raw lines turn into JSON lines once a stage has changed the rows."""
    if output == "raw" and not result.query.stages and result.rows.raw:
        yield from raw(result, first)
    elif output in ("raw", "jsonl"):
        for line in jsonl(records(result, first, seen)):
            yield line.encode("utf-8", "surrogateescape")
    else:
        yield (table if output == "table" else csv_text)(records(result, first, seen)).encode()


def save(result: Result, path: str, output: str = "jsonl") -> None:
    """Write a result as a folder of JSON lines or CSV, by the executors; a folder has its rows in no order beyond that of each file."""
    columns = result.df.select(*[_plain(F.col(quoted(c)), t).alias(c) for c, t in zip(result.df.columns, [f.dataType for f in result.df.schema])])
    writer = columns.write.option("ignoreNullFields", "true")
    if output == "csv":
        flat = [F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) else F.col(quoted(f.name)) for f in columns.schema]
        columns.select(*flat).write.option("header", "true").option("lineSep", "\r\n").option("escape", '"').csv(path)
    elif output == "jsonl":
        writer.json(path)
    else:
        raise ValueError(f"can't save as {output!r}: jsonl or csv")


def _plain(source: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return times.label(times.column_micros(source, kind, "UTC"), "UTC")
    return source
