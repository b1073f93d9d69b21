"""The stats stage: grouped aggregation with event-time windows, a guard against too many groups, and a fixed order of groups."""

from __future__ import annotations

import weakref
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import times
from emberlog.functions.text import double_text
from emberlog.functions.values import BOOL, CONTAINER, NULL, NUMBER, STRING, Missing, Resolved, Resolver, Typed, Value, Variant, bound, column
from emberlog.operators.rows import Rows
from emberlog.plans.nodes import Aggregate, Path, Stats

OTHER = "(other)"
MAX_GROUPS, MAX_SAMPLE = 10_000, 100_000
SEPARATOR, IS_NULL, IS_MISSING = "\x1f", "\x00", "\x02"
QUANTILES = {"p50": "0.5", "p95": "0.95", "p99": "0.99"}


def _key(value: Value) -> Column:
    """Text of a group value; null, missing and the empty text differ."""
    if isinstance(value, Missing):
        return F.lit(IS_MISSING)
    if isinstance(value, Variant):
        return F.when(value.source.isNull(), F.lit(IS_MISSING)).otherwise(F.coalesce(value.text(), F.lit(IS_NULL)))
    return F.coalesce(value.text(), F.lit(IS_NULL if getattr(value, "null_as", "missing") == "null" else IS_MISSING))


def stats(rows: Rows, stage: Stats, max_groups: int | None = MAX_GROUPS, max_sample: int = MAX_SAMPLE, sketch: bool = False, streaming: bool = False) -> Rows:
    """One row for each group. Columns: window, the by paths, then a column for each function (s0, s1, ... in df); beside them, hidden:
    __key (order of groups), __is_other, __n (rows of the group) and kinds of texts.

    max_groups: further groups, in order of arrival, become one; None: no guard. sketch: percentiles from a mergeable sketch, for groups
    whose values an executor can't hold. Sums of integers are exact; those that pass 64 bits are doubles beside a null.
    """
    resolver, df = rows.resolver, rows.df
    group, shown, codes = [], [], {}
    window = None
    if stage.every is not None:
        ts = resolver.resolve(Path(("ts",)))
        window = F.lit(None).cast("long") if isinstance(ts, Missing) else times.bucket(ts.micros(), stage.every, resolver.tz)
        df = df.withColumn("__window", window)
    values = []
    for k, p in enumerate(stage.by):
        df, value = bound(df, resolver.resolve(p), f"by{k}")
        values.append(value)
    arrival = F.struct(*rows.order) if rows.arrival else None
    # typed values group as they are, others by their texts
    plain = [isinstance(v, (Typed, Missing)) and v.static not in (CONTAINER,) for v in values]
    for k, (v, as_is) in enumerate(zip(values, plain)):
        df = df.withColumn(f"__by{k}", (v.sound() if isinstance(v, Typed) else v.native()) if as_is else _key(v))
    group = (["__window"] if window is not None else []) + [f"__by{k}" for k in range(len(values))]
    lines = resolver.root is not None
    guarded = max_groups is not None and bool(group) and not streaming
    overflowed = False
    if guarded and not lines:
        # looks at the keys alone, so a scan of a table reads only their columns
        overflowed = df.select(*group).distinct().limit(max_groups + 1).count() > max_groups
    aggregates: list[Column] = [F.count(F.lit(1)).alias("__n")]
    for k, (v, as_is) in enumerate(zip(values, plain)):
        if not as_is:
            first = (lambda c: F.min_by(c, arrival)) if arrival is not None else F.first
            aggregates += [first(v.text()).alias(f"__text{k}"), first(v.code()).alias(f"__code{k}")]
    finish: list[Column] = []
    for n, f in enumerate(stage.functions):
        df, value = bound(df, resolver.resolve(f.path), f"f{n}") if f.path else (df, Missing())
        if f.function in QUANTILES:
            df = df.withColumn(f"__p{n}", _number(value))
        made, out = _function(f, n, value, resolver, arrival, max_sample, sketch, streaming)
        aggregates += made
        finish += out
    kept = None
    if guarded and lines:
        # decoding lines costs more than all else, so the groups are made once, kept, and counted; they are the result but for the guard
        kept = df.groupBy(*group).agg(*aggregates).persist()
        overflowed = kept.count() > max_groups
    if overflowed:
        if kept is not None:
            kept.unpersist()
            kept = None
        df, group = _guarded(df, group, arrival, max_groups), [*group, "__is_other"]
    grouped = kept if kept is not None else df.groupBy(*group).agg(*aggregates) if group else df.agg(*aggregates)
    if kept is not None:
        weakref.finalize(kept, kept._jdf.unpersist, False).atexit = False
    other = F.col("__is_other") if overflowed else F.lit(False)
    texts, names = [], []
    if window is not None:
        label = F.coalesce(times.label(F.col("__window"), resolver.tz), F.lit(times.NO_TS))
        shown.append(F.when(other, F.lit(OTHER)).otherwise(label))
        texts.append(F.coalesce(times.label(F.col("__window"), resolver.tz), F.lit(IS_MISSING)))
        names.append("window")
    hidden = [F.col("__n")]
    for k, (path, v, as_is) in enumerate(zip(stage.by, values, plain)):
        name = path.text
        names.append(name)
        if as_is:
            source = F.col(f"__by{k}")
            again = Typed(source, v.type, v.null_as, v.tz) if isinstance(v, Typed) else v
            texts.append(_key(again))
            if overflowed:  # the row of the others shows a text, so the column is one
                shown.append(F.when(other, F.lit(OTHER)).otherwise(again.text()))
            else:
                shown.append(source)
            code = again.code()
        else:
            texts.append(F.col(f"__by{k}"))
            shown.append(F.when(other, F.lit(OTHER)).otherwise(F.col(f"__text{k}")))
            code = F.col(f"__code{k}")
        codes[name] = f"__code_{k}"
        hidden.append(F.when(other, F.lit("s")).otherwise(code).alias(f"__code_{k}"))
    key = F.concat_ws(SEPARATOR, *texts) if texts else F.lit("")
    out = []
    for f, c in zip(stage.functions, finish[::2]):
        out.append(F.when(other, F.lit(None)).otherwise(c) if overflowed and f.function == "count_distinct" else c)
    for n, c in enumerate(finish[1::2]):
        hidden.append(c.alias(f"__note{n}"))
    names += [f.column for f in stage.functions]
    inner = tuple(f"s{k}" for k in range(len(names)))
    df = grouped.select(*[c.alias(s) for c, s in zip([*shown, *out], inner)], key.alias("__key"), other.alias("__is_other"), *hidden)
    schema = df.schema
    kinds = {name: (s, schema[s].dataType) for name, s in zip(names, inner)}
    order = (F.col("__is_other").asc(), F.col("__key").asc())
    notes = {f.column: f"__note{n}" for n, f in enumerate(stage.functions)}
    return replace(
        rows, df=df if streaming or not group else df.orderBy(*order), resolver=Resolver(kinds, None, "missing", resolver.tz), columns=tuple(names), inner=inner, arrival=("__is_other", "__key"), raw=None, codes=codes, sorted_by=order,
        notes={**rows.notes, "columns": notes, "functions": {f.column: f.function for f in stage.functions}, "overflowed": overflowed if guarded or not group else None, "kept": kept, "in_order": False},
    )


def _guarded(df: DataFrame, group: list[str], arrival: Column | None, most: int) -> DataFrame:
    """df with the groups after the first `most`, by arrival, folded into one."""
    firsts = df.groupBy(*group).agg(F.min(arrival if arrival is not None else F.lit(0)).alias("__first"))
    kept = firsts.orderBy("__first", *group).limit(most).select(*[F.col(g).alias(f"__kept{n}") for n, g in enumerate(group)], F.lit(True).alias("__known"))
    match = F.lit(True)
    for n, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__kept{n}"))
    # sizes that are known at run time decide whether the keys are broadcast
    joined = df.join(kept, match, "left").withColumn("__is_other", F.col("__known").isNull())
    for g in group:
        joined = joined.withColumn(g, F.when(~F.col("__is_other"), F.col(g)))
    return joined.drop("__known", *[f"__kept{n}" for n in range(len(group))])


def _number(value: Value) -> Column:
    if isinstance(value, Typed):
        return value.sound() if value.static == NUMBER else F.lit(None).cast("double")
    return value.number() if isinstance(value, Variant) else F.lit(None).cast("double")


def _function(f: Aggregate, n: int, value: Value, resolver: Resolver, arrival: Column | None, max_sample: int, sketch: bool, streaming: bool) -> tuple[list[Column], list[Column]]:
    """Aggregates of a function, then its result and a note for renderers: i (whole), a (approximate), kind letters."""
    if f.path is None:
        return [], [F.col("__n"), F.lit("i")]
    name, total, note = f"__a{n}", f"__t{n}", f"__k{n}"
    number, x, y = _number(value), F.col(name), F.col(total)
    whole = isinstance(value, Typed) and value.is_integer
    if f.function == "sum":
        if whole:
            exact = F.coalesce(x, F.lit(0).cast("decimal(38,0)"))
            fits = exact.try_cast("long")
            return [F.sum(number.cast("decimal(38,0)")).alias(name)], [fits, F.when(fits.isNotNull(), F.lit("i")).otherwise(exact.cast("double").cast("string"))]
        if isinstance(value, Variant):
            whole_part, fraction = value.integer(), F.when(value.integer().isNull(), value.number())
            exact = F.coalesce(y, F.lit(0).cast("decimal(38,0)"))
            made = [F.sum(fraction).alias(name), F.sum(whole_part.cast("decimal(38,0)")).alias(total), F.count(fraction).alias(note)]
            return made, [F.when(F.col(note) > 0, x + exact.cast("double")).otherwise(exact.cast("double")), F.when((F.col(note) == 0) & exact.try_cast("long").isNotNull(), F.lit("i")).otherwise(F.lit("f"))]
        none = isinstance(value, Missing) or value.static != NUMBER
        return [F.sum(number).cast("double").alias(name), F.count(number).alias(total)], [F.lit(0).cast("long") if none else F.coalesce(x, F.lit(0.0)), F.when(y == 0, F.lit("i")).otherwise(F.lit("f"))]
    if f.function == "avg":
        return [F.avg(number.cast("double")).alias(name)], [x, F.lit("f")]
    if f.function in QUANTILES:
        q = QUANTILES[f.function]
        if sketch:
            made = [F.percentile_approx(number, float(q), 10_000).alias(name), F.count(number).alias(total)]
        else:
            made = [F.expr(f"percentile_disc({q}) within group (order by __p{n})").alias(name), F.count(number).alias(total)]  # nearest rank: an observed value
        result = x.cast(value.type) if whole else x.cast("double")
        exact_note = F.when(y > max_sample, F.lit("a")).otherwise(F.lit("i" if whole else "f"))
        if isinstance(value, Variant):
            exact_note = F.when(y > max_sample, F.lit("a")).when(x == F.floor(x), F.lit("v")).otherwise(F.lit("f"))
        return made, [result, exact_note]
    if f.function == "count_distinct":
        if isinstance(value, Missing):
            return [], [F.lit(0).cast("long"), F.lit("i")]
        distinct = value.sound() if isinstance(value, Typed) and value.static != CONTAINER else _key(value)
        missing = value.source.isNull() if isinstance(value, Variant) else F.lit(False)
        counted = F.when(~missing, distinct) if isinstance(value, Variant) else distinct
        if streaming:
            made = [F.size(F.collect_set(counted)).cast("long").alias(name)]
        else:
            made = [F.count_distinct(counted).alias(name)]
        result = x
        if isinstance(value, Typed) and value.null_as == "null":
            made.append(F.max(value.sound().isNull().cast("long")).alias(total))
            result = x + F.coalesce(y, F.lit(0))
        return made, [result, F.lit("i")]
    return _extreme(f.function, value, n, resolver, arrival)


def _extreme(function: str, value: Value, n: int, resolver: Resolver, arrival: Column | None) -> tuple[list[Column], list[Column]]:
    take = F.min if function == "min" else F.max
    name = f"__a{n}"
    if isinstance(value, Typed):
        if value.static in (CONTAINER, NULL):
            return [], [F.lit(None).cast("string"), F.lit("f")]
        return [take(value.sound()).alias(name)], [F.col(name), F.lit({NUMBER: "i" if value.is_integer else "f", STRING: "s", BOOL: "b"}.get(value.static, "t"))]
    if isinstance(value, Resolved):
        return [take(value.source).alias(name)], [times.label(F.col(name), resolver.tz), F.lit("s")]
    if isinstance(value, Missing):
        return [], [F.lit(None).cast("string"), F.lit("f")]
    # the kind of the first value that has an order decides which values count
    orderable = F.when(column(value.has(NUMBER)), F.lit("n")).when(column(value.has(STRING)), F.lit("s")).when(column(value.has(BOOL)), F.lit("b"))
    first = F.min(F.when(orderable.isNotNull(), F.struct((arrival if arrival is not None else F.lit(0)).alias("at"), orderable.alias("kind"))))
    kind = F.col(f"__k{n}")["kind"]
    made = [take(value.number()).alias(f"{name}n"), take(value.string()).alias(f"{name}s"), take(value.bool()).alias(f"{name}b"), first.alias(f"__k{n}"), take(F.when(value.kind == "BIGINT", value.integer())).alias(f"{name}i")]
    whole = F.col(f"{name}i").isNotNull() & (F.col(f"{name}i").cast("double") == F.col(f"{name}n"))
    text = F.when(kind == "n", F.when(whole, F.col(f"{name}i").cast("string")).otherwise(double_text(F.col(f"{name}n")))).when(kind == "s", F.col(f"{name}s")).when(kind == "b", F.col(f"{name}b").cast("string"))
    return made, [text, F.coalesce(kind, F.lit("f"))]
