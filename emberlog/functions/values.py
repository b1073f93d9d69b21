"""Values of rows: typed columns whose kind is known when a query is compiled, and VARIANT values whose kind is known per row.

A missing field is SQL NULL in a VARIANT row, and an explicit null is a variant null. A typed column has one NULL: null_as says whether it
is a present null ("null") or a missing field ("missing"). A NaN, which no text can hold, reads as NULL; infinities are numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions import times
from emberlog.functions.text import double_text
from emberlog.plans import durations
from emberlog.plans.nodes import Literal, Path

Guard = bool | Column

NUMBER, STRING, BOOL, TIMESTAMP, DURATION, NULL, CONTAINER = "number", "string", "bool", "timestamp", "duration", "null", "container"
#: Letters that stand for the kinds beside a text column.
CODES = {NUMBER: "n", STRING: "s", BOOL: "b", TIMESTAMP: "t", DURATION: "d", NULL: "z", CONTAINER: "c"}


def both(*guards: Guard) -> Guard:
    out: Guard = True
    for g in guards:
        if g is False or out is False:
            return False
        out = g if out is True else out if g is True else out & g
    return out


def column(guard: Guard) -> Column:
    return F.lit(guard) if isinstance(guard, bool) else guard


class Value:
    """What a path or a literal gives. has(kind) tells when it is of a kind; the columns of a kind are null for rows of other kinds."""

    present: Guard = True
    static: str | None = None

    def has(self, kind: str) -> Guard:
        raise NotImplementedError

    def number(self) -> Column:
        """As a double."""
        raise NotImplementedError

    def integer(self) -> Column | None:
        """As a long, null for other numbers; None if it never is one."""
        return None

    def string(self) -> Column:
        raise NotImplementedError

    def bool(self) -> Column:
        raise NotImplementedError

    def micros(self) -> Column:
        raise NotImplementedError

    def container(self) -> Column:
        """JSON text of an array or object."""
        raise NotImplementedError

    def text(self) -> Column:
        """Canonical text; null for null and missing."""
        raise NotImplementedError

    def code(self) -> Column:
        """Letter of the kind; m if missing."""
        raise NotImplementedError


class Missing(Value):
    present = False
    static = "missing"

    def has(self, kind: str) -> Guard:
        return False

    def text(self) -> Column:
        return F.lit(None).cast("string")

    def code(self) -> Column:
        return F.lit("m")

    def native(self) -> Column:
        return F.lit(None).cast("string")


class Constant(Value):
    def __init__(self, literal: Literal):
        self.literal, self.static = literal, literal.kind
        self.duration = durations.parse(str(literal.value)) if literal.kind == DURATION else None
        if literal.kind == DURATION and self.duration is None:
            self.present, self.static = False, "missing"

    def has(self, kind: str) -> Guard:
        return self.static == kind

    def native(self) -> Column:
        return F.lit(self.literal.value)

    def number(self) -> Column:
        return F.lit(float(self.literal.value))

    def integer(self) -> Column | None:
        return F.lit(self.literal.value).cast("long") if isinstance(self.literal.value, int) else None

    def string(self) -> Column:
        return F.lit(self.literal.value)

    bool = string


class Typed(Value):
    """A column of a declared type."""

    def __init__(self, source: Column, kind: T.DataType, null_as: str, tz: str):
        self.source, self.type, self.null_as, self.tz = source, kind, null_as, tz
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
            self.static = NUMBER
        elif isinstance(kind, T.BooleanType):
            self.static = BOOL
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            self.static = TIMESTAMP
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            self.static = CONTAINER
        elif isinstance(kind, T.NullType):
            self.static = NULL
        else:
            self.static = STRING
        self.is_float = isinstance(kind, (T.FloatType, T.DoubleType))
        self.present = True if null_as == "null" else self.sound().isNotNull()

    def sound(self) -> Column:
        """The column with NaN as null."""
        return F.when(~F.isnan(self.source), self.source) if self.is_float else self.source

    @property
    def is_integer(self) -> bool:
        return isinstance(self.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    def has(self, kind: str) -> Guard:
        if kind == NULL:
            return self.sound().isNull() if self.null_as == "null" else False
        return kind == self.static

    def native(self) -> Column:
        return self.source

    def number(self) -> Column:
        return self.sound().cast("double")

    def integer(self) -> Column | None:
        return self.source.cast("long") if self.is_integer else None

    def string(self) -> Column:
        return self.source if isinstance(self.type, T.StringType) else self.source.cast("string")

    def bool(self) -> Column:
        return self.source

    def micros(self) -> Column:
        return times.column_micros(self.source, self.type, self.tz)

    def container(self) -> Column:
        return F.to_json(self.source)

    def text(self) -> Column:
        if self.static == NUMBER:
            return self.source.cast("string") if self.is_integer else double_text(self.number())
        if self.static == TIMESTAMP:
            return times.label(self.micros(), self.tz)
        return self.container() if self.static == CONTAINER else self.string()

    def code(self) -> Column:
        return F.when(self.sound().isNull(), F.lit("z" if self.null_as == "null" else "m")).otherwise(F.lit(CODES[self.static]))


class Resolved(Value):
    """The row's timestamp: microseconds, and the typed column they come from, if there is one, for filters to reach the scan."""

    static = TIMESTAMP

    def __init__(self, source: Column, tz: str, native: Column | None = None, kind: T.DataType | None = None):
        self.source, self.tz, self.column, self.type = source, tz, native, kind
        self.present = source.isNotNull()

    def has(self, kind: str) -> Guard:
        return kind == TIMESTAMP

    def native(self) -> Column:
        return F.timestamp_micros(self.source)

    def micros(self) -> Column:
        return self.source

    def text(self) -> Column:
        return times.label(self.source, self.tz)

    def code(self) -> Column:
        return F.when(self.source.isNull(), F.lit("m")).otherwise(F.lit("t"))

    def compare(self, op: str, at: int | Column) -> Column:
        """Comparison with microseconds; on a typed column with a literal of its type."""
        if isinstance(at, Column):
            return COMPARE[op](self.source, at)
        if isinstance(self.type, T.TimestampNTZType):
            return COMPARE[op](self.column, F.expr(f"timestampadd(MICROSECOND, {at}L, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))
        if isinstance(self.type, T.TimestampType):
            return COMPARE[op](self.column, F.expr(f"timestamp_micros({at}L)"))
        return COMPARE[op](self.source, F.lit(at))


def _once(method: Callable) -> Callable:
    """Build a column once for a value; each part of it is a call to the JVM."""

    @wraps(method)
    def cached(self, *args):
        key = (method.__name__, *args)
        if key not in self.made:
            self.made[key] = method(self, *args)
        return self.made[key]

    return cached


class Variant(Value):
    """A VARIANT value whose kind is looked up in each row."""

    def __init__(self, source: Column, kind: Column | None = None):
        self.source, self.made = source, {}
        self.present = source.isNotNull()
        self.kind = F.schema_of_variant(source) if kind is None else kind
        self.double = F.try_variant_get(source, "$", "double")

    @_once
    def has(self, kind: str) -> Guard:
        number = self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL")
        finite = F.abs(self.double) != float("inf")
        if kind == NUMBER:
            return F.coalesce(number & finite, F.lit(False))
        if kind == NULL:  # a number that no double can hold reads as null
            return F.coalesce((self.kind == "VOID") | (number & ~finite), F.lit(False))
        if kind == CONTAINER:
            return F.coalesce(self.kind.startswith("OBJECT") | self.kind.startswith("ARRAY"), F.lit(False))
        return F.coalesce(self.kind == {STRING: "STRING", BOOL: "BOOLEAN"}.get(kind, "-"), F.lit(False)) if kind in (STRING, BOOL) else False

    @_once
    def _as(self, kind: str, name: str) -> Column:
        return F.when(column(self.has(kind)), F.try_variant_get(self.source, "$", name))

    def number(self) -> Column:
        return self._as(NUMBER, "double")

    @_once
    def integer(self) -> Column | None:
        return F.when(self.kind == "BIGINT", F.try_variant_get(self.source, "$", "bigint"))

    def string(self) -> Column:
        return self._as(STRING, "string")

    def bool(self) -> Column:
        return self._as(BOOL, "boolean")

    @_once
    def container(self) -> Column:
        return F.when(column(self.has(CONTAINER)), F.to_json(self.source))

    @_once
    def text(self) -> Column:
        number = F.when(self.kind == "BIGINT", self.integer().cast("string")).otherwise(double_text(self.number()))
        return F.when(column(self.has(NUMBER)), number).when(column(self.has(STRING)), self.string()).when(column(self.has(BOOL)), self.bool().cast("string")).when(column(self.has(CONTAINER)), self.container())

    @_once
    def code(self) -> Column:
        out = F.when(self.source.isNull(), F.lit("m"))
        for kind in (NUMBER, STRING, BOOL, CONTAINER):
            out = out.when(column(self.has(kind)), F.lit(CODES[kind]))
        return out.otherwise(F.lit("z"))

    def native(self) -> Column:
        return self.source


COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass(frozen=True)
class Resolver:
    """Finds the value of a path. names: fields that have a column of their own; root: a VARIANT column with all others, if any."""

    names: dict[str, tuple[str, T.DataType]]
    root: str | None = None
    null_as: str = "null"
    tz: str = "UTC"
    ts: str | None = None  # column of microseconds
    ts_native: tuple[str, T.DataType] | None = None
    parsed: frozenset[str] = field(default_factory=frozenset)  # text columns that hold JSON

    def resolve(self, path: Path) -> Value:
        if path.is_ts:
            if self.ts_native:
                native = F.col(quoted(self.ts_native[0]))
                return Resolved(times.column_micros(native, self.ts_native[1], self.tz), self.tz, native, self.ts_native[1])
            return Resolved(F.col(self.ts), self.tz) if self.ts else Missing()
        first, *rest = path.segments
        if first in self.names:
            name, kind = self.names[first]
            source = F.col(quoted(name))
            if isinstance(kind, T.VariantType):
                return Variant(_get(source, rest))
            if first in self.parsed and rest:
                return Variant(_get(F.try_parse_json(source), rest))
            return self._inside(source, kind, rest)
        return Variant(_get(F.col(self.root), path.segments)) if self.root else Missing()

    def _inside(self, source: Column, kind: T.DataType, rest: list[str | int]) -> Value:
        for s in rest:
            if isinstance(kind, T.StructType) and isinstance(s, str) and s in kind.names:
                source, kind = source.getField(s), kind[s].dataType
            elif isinstance(kind, T.MapType) and isinstance(s, str) and isinstance(kind.keyType, T.StringType):
                source, kind = F.try_element_at(source, F.lit(s)), kind.valueType
            elif isinstance(kind, T.ArrayType) and isinstance(s, int) and 0 <= s < 2**31 - 1:
                source, kind = F.get(source, F.lit(s)), kind.elementType
            else:
                return Missing()
        return Typed(source, kind, "missing" if rest else self.null_as, self.tz)


def _get(source: Column, segments) -> Column:
    """Value below a variant; null where there is none."""
    path = "$"
    for s in segments:
        if isinstance(s, int):
            if not 0 <= s < 2**31:
                return F.lit(None).cast("variant")
            path += f"[{s}]"
        elif "'" in s or '"' in s or not s:
            return _by_key(source, path, s, segments)
        else:
            path += f"['{s}']"
    return F.try_variant_get(source, path, "variant") if segments else source


def _by_key(source: Column, path: str, key: str, segments) -> Column:
    """Field names that a path text can't quote are looked up as keys of the object."""
    segments = list(segments)
    at = segments.index(key)
    inner = F.try_variant_get(source, path, "variant") if path != "$" else source
    found = F.try_element_at(F.try_variant_get(inner, "$", "map<string,variant>"), F.lit(key))
    return _get(found, segments[at + 1 :])


def bound(df: DataFrame, value: Value, name: str) -> tuple[DataFrame, Value]:
    """df with a VARIANT value and its kind as columns, so that many uses look it up once; other values stay as they are."""
    if not isinstance(value, Variant):
        return df, value
    df = df.withColumn(f"__v_{name}", value.source)
    df = df.withColumn(f"__d_{name}", F.schema_of_variant(f"__v_{name}"))
    return df, Variant(F.col(f"__v_{name}"), F.col(f"__d_{name}"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
