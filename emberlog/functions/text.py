"""Canonical text of numbers, as a column expression and in Python."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: int | float) -> str:
    """Shortest digits that give x again; exponents of 6 and more or below -4 are written out."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return "NaN" if x != x else ("+Inf" if x > 0 else "-Inf")
    sign, digits, exponent = _digits(x)
    if not -4 <= exponent < 6:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    whole = digits.ljust(exponent + 1, "0")
    return sign + whole[: exponent + 1] + ("." + whole[exponent + 1 :] if len(whole) > exponent + 1 else "")


def _digits(x: float) -> tuple[str, str, int]:
    mantissa, _, power = repr(abs(x)).partition("e")
    whole, _, fraction = mantissa.partition(".")
    exponent = len(whole) - 1 + int(power or 0)
    digits = whole + ("" if fraction == "0" else fraction)
    stripped = digits.lstrip("0")
    exponent -= len(digits) - len(stripped)
    return "-" if math.copysign(1, x) < 0 else "", stripped.rstrip("0") or "0", exponent if stripped else 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def double_text(x: Column) -> Column:
    """number_text of a double column; whole numbers below a million take the short way."""

    def parts(v: Column) -> Column:
        """Digits of the value, and the power of ten of the first one."""
        text = F.abs(v).cast("string")
        found = F.struct(F.regexp_extract(text, r"^([0-9]+)", 1).alias("whole"), F.regexp_extract(text, r"\.([0-9]+)", 1).alias("fraction"), F.regexp_extract(text, r"E(-?[0-9]+)$", 1).alias("power"))
        return let(found, lambda p: F.struct(F.concat(p["whole"], F.when(p["fraction"] == "0", F.lit("")).otherwise(p["fraction"])).alias("digits"), (F.length(p["whole"]) - 1 + F.when(p["power"] != "", p["power"].cast("int")).otherwise(F.lit(0))).alias("exponent")))

    def trimmed(p: Column) -> Column:
        stripped = F.regexp_replace(p["digits"], "^0+", "")
        return F.struct(F.regexp_replace(stripped, "0+$", "").alias("short"), (p["exponent"] - F.length(p["digits"]) + F.length(stripped)).alias("exponent"))

    def written(p: Column) -> Column:
        short, exponent = p["short"], p["exponent"]
        dotted = F.when(F.length(short) > 1, F.concat(F.lit("."), F.substr(short, F.lit(2)))).otherwise(F.lit(""))
        power = F.abs(exponent).cast("string")
        power = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
        scientific = F.concat(F.substr(short, F.lit(1), F.lit(1)), dotted, power)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), short)
        padded = F.rpad(short, F.greatest(F.length(short), exponent + 1), F.lit("0"))
        plain = F.concat(F.substr(padded, F.lit(1), exponent + 1), F.when(F.length(padded) > exponent + 1, F.concat(F.lit("."), F.substr(padded, exponent + 2))).otherwise(F.lit("")))
        return F.when((exponent < -4) | (exponent >= 6), scientific).when(exponent < 0, small).otherwise(plain)

    def text(v: Column) -> Column:
        long_way = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), let(let(parts(v), trimmed), written))
        return F.when((F.floor(v) == v) & (F.abs(v) < 1e6), v.cast("long").cast("string")).otherwise(long_way)

    return let(x, text)
