"""Filter nodes as Boolean columns.

The language has two truth values; SQL has three. At the top of a filter NULL and false are the same, so there a leaf stays the bare
comparison, which reaches the scan. Below a negation, each leaf is made two-valued first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions import patterns
from emberlog.functions.values import BOOL, COMPARE, CONTAINER, DURATION, NULL, NUMBER, STRING, TIMESTAMP, Constant, Missing, Resolved, Resolver, Typed, Value, both, column
from emberlog.plans.nodes import And, Compare, Exists, Filter, In, Literal, Match, Not, Operand, Or, Path

#: Ordinals of level names, and the fields that hold levels. Fixed values of the language.
LEVELS = {"trace": 10, "debug": 20, "info": 30, "warn": 40, "warning": 40, "error": 50, "fatal": 60}
LEVEL_FIELDS = ("level", "severity", "lvl", "loglevel")
#: Texts that count as numbers.
NUMERIC = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


@dataclass(frozen=True)
class Context:
    """What a filter depends on besides the row: the run's time in microseconds (a column where it moves on), and the level table."""

    now: int | Column
    levels: dict[str, int] = field(default_factory=lambda: dict(LEVELS))


def condition(node: Filter, rows: Resolver, context: Context, positive: bool = True) -> Column:
    """Column that is true for the rows that match. positive: whether NULL may stand for false."""
    if isinstance(node, And):
        return condition(node.left, rows, context, positive) & condition(node.right, rows, context, positive)
    if isinstance(node, Or):
        return condition(node.left, rows, context, positive) | condition(node.right, rows, context, positive)
    if isinstance(node, Not):
        return ~condition(node.inner, rows, context, False)
    leaf = _leaf(node, rows, context)
    if isinstance(leaf, bool):
        return F.lit(leaf)
    return leaf if positive else F.coalesce(leaf, F.lit(False))


def _leaf(node: Filter, rows: Resolver, context: Context) -> Column | bool:
    if isinstance(node, Exists):
        return rows.resolve(node.path).present
    if isinstance(node, Match):
        value = _value(node.operand, rows)
        found = patterns.translate(node.pattern, node.position)
        text = both(value.has(STRING), value.present)
        if text is False:
            return False
        hit = value.string().rlike(found)
        bare = value.static == STRING
        hit = ~hit if node.negated else hit
        return hit if bare else column(text) & hit
    if isinstance(node, In):
        return _among(rows.resolve(node.path), node.values)
    left, right = _value(node.left, rows), _value(node.right, rows)
    if left.present is False or right.present is False:
        return False
    if node.op == "==":
        return _any(_equal(left, right, context))
    if node.op == "!=":
        return _unequal(left, right, context)
    return _ordered(node, left, right, context)


def _value(operand: Operand, rows: Resolver) -> Value:
    return rows.resolve(operand) if isinstance(operand, Path) else Constant(operand)


def _any(choices: list) -> Column | bool:
    out: Column | bool = False
    for guard, expression in choices:
        one = expression if guard is True else column(guard) & expression
        out = one if out is False else out | one
    return out


def _numbers(op: str, a: Value, b: Value) -> Column:
    """Comparison of numbers: exact where both are integers, else as doubles. A NaN compares with nothing; that it is none is asked beside
    the comparison, which the scan can use."""
    found = _bare_numbers(op, a, b)
    for x in (a, b):
        if isinstance(x, Typed) and x.is_float and not (op in ("<", "<=", "==") and x is a and isinstance(b, Constant)):
            found = found & ~F.isnan(x.source)
    return found


def _bare_numbers(op: str, a: Value, b: Value) -> Column:
    for x in (a, b):
        if isinstance(x, Constant) and abs(x.literal.value) < 2**53:  # a double tells it from all integers
            return COMPARE[op](a.native() if isinstance(a, (Typed, Constant)) else a.number(), b.native() if isinstance(b, (Typed, Constant)) else b.number())
    if isinstance(a, (Typed, Constant)) and isinstance(b, (Typed, Constant)):
        return COMPARE[op](a.native(), b.native())
    x, y = a.integer(), b.integer()
    wide = COMPARE[op](a.number(), b.number())
    return wide if x is None or y is None else F.when(x.isNotNull() & y.isNotNull(), COMPARE[op](x, y)).otherwise(wide)


def numeric(value: Value) -> Column:
    """A numeric text as a double, else null."""
    number = value.string().try_cast("double")
    return F.when(value.string().rlike(NUMERIC) & (F.abs(number) != float("inf")), number)


def _coerced(op: str, a: Value, b: Value) -> list:
    """A numeric text beside a number."""
    out = []
    for x, y, flip in ((a, b, False), (b, a, True)):
        guard = both(x.has(STRING), y.has(NUMBER))
        if guard is not False:
            if isinstance(x, Constant):
                number = _literal_number(str(x.literal.value))
                if number is None:
                    continue
                text = F.lit(number)
            else:
                text = numeric(x)
            # integers beside a whole constant stay integers, so that the scan can use the filter
            if isinstance(x, Constant) and isinstance(y, Typed) and y.is_integer and float(number).is_integer() and abs(number) < 2**53:
                text, other = F.lit(int(number)), y.native()
            else:
                other = y.number()
            out.append((True, COMPARE[op](other, text) if flip else COMPARE[op](text, other)))
    return out


def _literal_number(text: str) -> float | None:
    import re

    return float(text) if re.match(NUMERIC.replace(r"\z", r"\Z"), text) and abs(float(text)) != float("inf") else None


def _instants(op: str, a: Value, b: Value, context: Context) -> list:
    """A timestamp beside a duration, which counts from now."""
    out = []
    mirrored = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    for x, y, way in ((a, b, op), (b, a, mirrored.get(op, op))):
        if isinstance(y, Constant) and y.has(DURATION) is True:
            at = context.now + y.duration
            if isinstance(x, Resolved):
                out.append((True, x.compare(way, at)))
            elif (guard := x.has(TIMESTAMP)) is not False:
                out.append((guard, COMPARE[way](x.micros(), F.lit(at))))
    return out


def _same_kind(op: str, a: Value, b: Value) -> list:
    """Columns of a kind are null in rows of other kinds, so they need no guard of their own."""
    out = []
    if both(a.has(NUMBER), b.has(NUMBER)) is not False:
        out.append((True, _numbers(op, a, b)))
    if both(a.has(STRING), b.has(STRING)) is not False:
        out.append((True, COMPARE[op](a.string(), b.string())))
    if both(a.has(BOOL), b.has(BOOL)) is not False:
        out.append((True, COMPARE[op](a.bool(), b.bool())))
    if both(a.has(TIMESTAMP), b.has(TIMESTAMP)) is not False:
        out.append((True, COMPARE[op](a.micros(), b.micros())))
    if both(a.has(DURATION), b.has(DURATION)) is True:
        out.append((True, COMPARE[op](F.lit(a.duration), F.lit(b.duration))))
    return out


def _equal(a: Value, b: Value, context: Context | None) -> list:
    out = _same_kind("==", a, b) + _coerced("==", a, b)
    if context is not None:
        out += _instants("==", a, b, context)
    if (g := both(a.has(NULL), b.has(NULL))) is not False:
        out.append((True, column(g)))
    if (g := both(a.has(CONTAINER), b.has(CONTAINER))) is not False:
        out.append((g, a.container() == b.container()))
    return out


def _unequal(a: Value, b: Value, context: Context) -> Column | bool:
    if isinstance(a, Constant):
        a, b = b, a
    if isinstance(a, Typed) and isinstance(b, Constant):
        if b.static == NULL:
            return a.sound().isNotNull() if a.null_as == "null" else a.present
        if a.static == b.static and a.static in (NUMBER, STRING, BOOL) and (a.null_as == "null" or not a.is_float):
            return ~a.native().eqNullSafe(b.native()) if a.null_as == "null" else a.native() != b.native()
    same = _any(_equal(a, b, context))
    present = both(a.present, b.present)
    if same is False:
        return present
    return column(present) & ~F.coalesce(same, F.lit(False))


def _is_level(operand: Operand) -> bool:
    return isinstance(operand, Path) and operand.segments[-1] in LEVEL_FIELDS


def _ordinal(value: Value, context: Context) -> Column | None:
    if isinstance(value, Constant):
        if value.static == STRING:
            found = context.levels.get(str(value.literal.value).lower())
            return None if found is None else F.lit(found).cast("long")
        return F.lit(int(value.literal.value)).cast("long") if value.static == NUMBER else None
    choices = []
    if (g := value.has(STRING)) is not False:
        table = F.create_map(*[F.lit(x) for pair in context.levels.items() for x in pair])
        choices.append((g, F.try_element_at(table, F.lower(value.string())).cast("long")))
    if (g := value.has(NUMBER)) is not False:
        choices.append((g, value.number().cast("long")))
    if not choices:
        return None
    return choices[0][1] if len(choices) == 1 else F.coalesce(*[F.when(column(g), x) for g, x in choices])


def _ordered(node: Compare, a: Value, b: Value, context: Context) -> Column | bool:
    plain = _any(_same_kind(node.op, a, b) + _instants(node.op, a, b, context) + _coerced(node.op, a, b))
    if not (_is_level(node.left) or _is_level(node.right)):
        return plain
    x, y = _ordinal(a, context), _ordinal(b, context)
    if x is None or y is None:
        return plain
    return F.when(x.isNotNull() & y.isNotNull(), COMPARE[node.op](x, y)).otherwise(column(plain))


def _among(value: Value, literals: tuple[Literal, ...]) -> Column | bool:
    if isinstance(value, Missing):
        return False
    if isinstance(value, Typed) and value.static in (NUMBER, STRING):
        plain = [x.value for x in literals if x.kind == value.static]
        rest = [x for x in literals if x.kind != value.static]
        found: Column | bool = value.native().isin(plain) if plain else False
        if value.is_integer and plain and not all(isinstance(x, int) for x in plain):
            found = value.number().isin([float(x) for x in plain])
    else:
        found, rest = False, list(literals)
    for x in rest:
        one = _any(_equal(value, Constant(x), None)) if x.kind != DURATION else False
        found = one if found is False else found if one is False else found | one
    return found
