"""The engine: a query text and an input give a Result, whose DataFrame Catalyst plans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import times
from emberlog.operators import rows as steps
from emberlog.operators import stats as aggregation
from emberlog.operators.filters import LEVELS, Context, condition
from emberlog.operators.rows import Rows, typed_rows
from emberlog.plans import durations
from emberlog.plans.nodes import Fields, Limit, Path, Query, Sort
from emberlog.plans.parser import MAX_QUERY, parse
from emberlog.sources import lines


@dataclass(frozen=True)
class Settings:
    """What a run depends on besides query and input."""

    tz: str = "UTC"
    now: datetime | None = None
    since: str | None = None
    until: str | None = None
    levels: dict[str, int] = field(default_factory=dict)
    max_groups: int | None = aggregation.MAX_GROUPS
    max_sample: int = aggregation.MAX_SAMPLE
    max_query: int = MAX_QUERY
    sketch: bool = False

    def context(self, rolling: bool = False) -> Context:
        now = F.unix_micros(F.current_timestamp()) if rolling and self.now is None else times.now_micros(self.now)
        return Context(now, LEVELS | {k.lower(): v for k, v in self.levels.items()})


@dataclass(frozen=True)
class Result:
    """df: the visible columns. rows: also what renderers and counters need."""

    query: Query
    rows: Rows

    @property
    def df(self) -> DataFrame:
        out = self.rows.df.select(*[F.col(c).alias(name) for c, name in zip(self.rows.inner, self.rows.columns)])
        out._groups = self.rows.notes.get("kept")  # groups in Spark's storage stay there as long as the result
        return out


def bound(text: str, now: int | Column) -> int | Column:
    """Microseconds of a time bound: RFC 3339, "now", or a duration from now."""
    if text == "now":
        return now
    if (d := durations.parse(text)) is not None:
        return now + d
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        at = None
    if at is None or at.tzinfo is None:
        raise ValueError(f"invalid time bound {text!r}: want RFC 3339, 'now', or a duration")
    return times.now_micros(at.astimezone(timezone.utc))


def bounds(rows: Rows, settings: Settings, now: int | Column) -> Column | None:
    """Condition of the rows that since and until keep."""
    ts, out = rows.resolver.resolve(Path(("ts",))), None
    for op, text in ((">=", settings.since), ("<=", settings.until)):
        if text is not None:
            at = bound(text, now)
            one = ts.compare(op, at) if ts.present is not False else F.lit(False)
            out = one if out is None else out & one
    return out


def run(query: Query, rows: Rows, settings: Settings = Settings(), streaming: bool = False) -> Rows:
    """The rows after the bounds, the filter and the stages of a query."""
    context = settings.context(streaming)
    within = bounds(rows, settings, context.now)
    rows = rows if within is None else rows.where(within)
    if query.filter is not None:
        rows = rows.where(condition(query.filter, rows.resolver, context))
    for stage in query.stages:
        rows = apply(stage, rows, settings, streaming)
    return rows


def needs_time(query: Query, settings: Settings) -> bool:
    """Whether a query looks at rows' timestamps."""

    def paths(node) -> Iterator[Path]:
        if isinstance(node, Path):
            yield node
        elif isinstance(node, tuple):
            for x in node:
                yield from paths(x)
        elif hasattr(node, "__dataclass_fields__"):
            for name in node.__dataclass_fields__:
                yield from paths(getattr(node, name))

    windows = any(getattr(s, "every", None) is not None for s in query.stages)
    return windows or settings.since is not None or settings.until is not None or any(p.is_ts for p in paths((query.filter, query.stages)))


def apply(stage, rows: Rows, settings: Settings, streaming: bool = False) -> Rows:
    if isinstance(stage, Fields):
        return steps.fields(rows, stage)
    if isinstance(stage, Sort):
        return steps.sort(rows, stage)
    if isinstance(stage, Limit):
        return steps.limit(rows, stage)
    return aggregation.stats(rows, stage, settings.max_groups, settings.max_sample, settings.sketch, streaming)


class Engine:
    """Runs queries over tables and over files of lines."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings

    def table(self, query: str, df: DataFrame, order_by: tuple[str, ...] = (), null_as: str = "null", json: tuple[str, ...] = (), ts: str | None = None, **settings) -> Result:
        """Query a table with declared columns; see operators.rows.typed_rows."""
        chosen = replace(self.settings, **settings)
        parsed = parse(query, chosen.max_query)
        return Result(parsed, run(parsed, typed_rows(df, order_by, null_as, json, chosen.tz, ts), chosen))

    def files(self, query: str, paths: list[str], options: lines.Options | None = None, **settings) -> Result:
        """Query the lines of files."""
        chosen = replace(self.settings, **settings)
        parsed = parse(query, chosen.max_query)
        found = lines.read(self.spark, paths, replace(options or lines.Options(tz=chosen.tz), time=needs_time(parsed, chosen)))
        return Result(parsed, run(parsed, replace(found.rows, notes={"lines": found}), chosen))

    def lines(self, query: str, df: DataFrame, line: str, order: str, format: str = "jsonl", **settings) -> Result:
        """Query a column of lines of a table."""
        chosen = replace(self.settings, **settings)
        parsed = parse(query, chosen.max_query)
        found = lines.from_lines(df, line, order, lines.Options(format=format, tz=chosen.tz, time=needs_time(parsed, chosen)))
        return Result(parsed, run(parsed, replace(found.rows, notes={"lines": found}), chosen))


