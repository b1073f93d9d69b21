"""Errors that point into the query text, and suggestions for misspelt words."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Position:
    line: int = 1
    col: int = 1

    def __str__(self) -> str:
        return f"{self.line}:{self.col}"


class QueryError(Exception):
    """A query that can't be compiled. code is E-PARSE or E-TYPE; position counts characters, not bytes."""

    def __init__(self, code: str, position: Position, message: str, suggestion: str | None = None):
        self.code, self.position, self.message, self.suggestion = code, position, message, suggestion
        super().__init__(f"{position}: {code}: {message}" + (f"; did you mean '{suggestion}'?" if suggestion else ""))


def distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions that lead from a to b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def suggest(word: str, known: Iterable[str], radius: int = 2) -> str | None:
    """The only closest known word within the radius; None where two are equally close."""
    near = sorted((distance(word, k), k) for k in known)
    if not near or near[0][0] > radius or (len(near) > 1 and near[1][0] == near[0][0]):
        return None
    return near[0][1]
