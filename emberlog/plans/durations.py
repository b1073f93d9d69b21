"""Duration texts such as 1h30m or -250ms, in microseconds."""

from __future__ import annotations

import re
from fractions import Fraction

#: Microseconds of each unit.
UNITS = {"ns": Fraction(1, 1000), "us": Fraction(1), "µs": Fraction(1), "μs": Fraction(1), "ms": Fraction(1000), "s": Fraction(10**6), "m": Fraction(60 * 10**6), "h": Fraction(3600 * 10**6)}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")
DAY = 24 * 3600 * 10**6


def parse(text: str) -> int | None:
    """Whole microseconds (towards zero) of a duration text; None if it is none."""
    sign = -1 if text.startswith("-") else 1
    body = text[1:] if text[:1] in ("-", "+") else text
    if body == "0":
        return 0
    total, at = Fraction(0), 0
    while at < len(body):
        if not (m := _PART.match(body, at)):
            return None
        number = m[1]
        total += Fraction(("0" + number if number[0] == "." else number).rstrip(".")) * UNITS[m[2]]
        at = m.end()
    if not body or total * 1000 >= 2**63:
        return None
    return sign * int(total)
