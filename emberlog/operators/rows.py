"""Rows on their way through a query: a DataFrame, how to resolve paths in it, and the order in which rows arrived."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.values import BOOL, CONTAINER, NUMBER, STRING, TIMESTAMP, Missing, Resolved, Resolver, Typed, Value, Variant, column, quoted
from emberlog.plans.nodes import Fields, Limit, Sort


@dataclass(frozen=True)
class Rows:
    """columns: the names that a reader sees, in order; inner: the columns of df that hold them, whose names are the engine's own, so that no
    name of a table can meet another one or differ from it in case alone.

    arrival: columns of df that give the order of arrival; none where it isn't known.
    raw: the column of the original lines while rows are still unchanged. codes: for columns of text, the column with their kinds.
    """

    df: DataFrame
    resolver: Resolver
    columns: tuple[str, ...]
    inner: tuple[str, ...]
    arrival: tuple[str, ...] = ()
    raw: str | None = None
    codes: dict[str, str] = field(default_factory=dict)
    sorted_by: tuple[Column, ...] = ()
    notes: dict = field(default_factory=dict)

    def where(self, condition: Column) -> Rows:
        return replace(self, df=self.df.filter(condition))

    @property
    def order(self) -> list[Column]:
        return [F.col(quoted(c)) for c in self.arrival]


def fields(rows: Rows, stage: Fields) -> Rows:
    """Project to paths; what a path doesn't find is missing in the row. The timestamp is no longer known."""
    picked, names = [], {}
    inner = tuple(f"p{k}" for k in range(len(stage.paths)))
    for path, name in zip(stage.paths, inner):
        value = rows.resolver.resolve(path)
        kind: T.DataType = T.VariantType() if isinstance(value, Variant) else value.type if isinstance(value, Typed) else T.TimestampType() if isinstance(value, Resolved) else T.StringType()
        picked.append(value.native().alias(name))
        if not isinstance(value, Missing):
            names[path.text] = (name, kind)
    keep = [F.col(quoted(c)) for c in rows.arrival]
    resolver = Resolver(names, None, rows.resolver.null_as, rows.resolver.tz)
    return replace(rows, df=rows.df.select(*picked, *keep), resolver=resolver, columns=tuple(p.text for p in stage.paths), inner=inner, raw=None, codes={})


def keys(value: Value) -> list[Column]:
    """Columns that order values: missing last, then by kind, then within it. Values without an order are equal."""
    if isinstance(value, Typed):
        return [value.sound()] if value.static in (NUMBER, STRING, BOOL, TIMESTAMP) else []
    if isinstance(value, Resolved):
        return [value.column if value.column is not None else value.source]
    if isinstance(value, Variant):
        return [value.number(), value.string(), value.bool()]
    return []


def _rank(value: Variant) -> Column:
    out = F.when(column(value.has(NUMBER)), F.lit(0))
    for n, kind in enumerate((STRING, BOOL, CONTAINER), 1):
        out = out.when(column(value.has(kind)), F.lit(n))
    return F.when(column(value.present), out.otherwise(F.lit(4)))


def sort(rows: Rows, stage: Sort) -> Rows:
    """The first rows by a path, ties in order of arrival."""
    value = rows.resolver.resolve(stage.path)
    by = [F.desc_nulls_last(k) if stage.descending else F.asc_nulls_last(k) for k in keys(value)]
    if isinstance(value, Variant):
        by = [_rank(value).asc_nulls_last(), *by]
    order = [*by, *(rows.sorted_by or [c.asc() for c in rows.order])]
    df = rows.df.orderBy(*order).limit(stage.limit) if order else rows.df.limit(stage.limit)
    return replace(rows, df=df, sorted_by=tuple(order))


def limit(rows: Rows, stage: Limit) -> Rows:
    """The first rows in their order; in order of arrival, if nothing sorted them."""
    order = list(rows.sorted_by) or rows.order
    df = rows.df.orderBy(*order).limit(stage.n) if order else rows.df.limit(stage.n)
    return replace(rows, df=df, sorted_by=tuple(order))


def typed_rows(df: DataFrame, order_by: tuple[str, ...] = (), null_as: str = "null", json: tuple[str, ...] = (), tz: str = "UTC", ts: str | None = None) -> Rows:
    """Rows of a table with declared columns. order_by: columns that give the order of arrival; json: text columns whose content paths
    may enter; ts: the column that holds the timestamp, by default the first candidate that can."""
    from emberlog.functions import times

    inner = tuple(f"f{k}" for k in range(len(df.columns)))
    names: dict[str, tuple[str, T.DataType]] = {}
    for f, c in zip(df.schema, inner):
        names.setdefault(f.name, (c, f.dataType))

    def place(name: str) -> str:
        near = [c for f, c in zip(df.columns, inner) if f.lower() == name.lower()]
        if name not in names and len(near) != 1:
            raise ValueError(f"{len(near)} columns of the table are called {name!r}")
        return names[name][0] if name in names else near[0]

    columns, arrival = tuple(df.columns), tuple(map(place, order_by))
    df = df.toDF(*inner)
    found = [names[ts]] if ts else [names[c] for c in times.CANDIDATES if c in names and times.column_micros(F.col(names[c][0]), names[c][1], tz) is not None]
    resolver = Resolver(names, None, null_as, tz, parsed=frozenset(json))
    if len(found) == 1 and isinstance(found[0][1], (T.TimestampType, T.TimestampNTZType)):
        resolver = replace(resolver, ts_native=found[0])
    elif found:
        df = df.withColumn("__ts", F.coalesce(*[times.column_micros(F.col(c), kind, tz) for c, kind in found]))
        resolver = replace(resolver, ts="__ts")
    return Rows(df, resolver, columns, inner, arrival)
