"""Nodes of a parsed query."""

from __future__ import annotations

from dataclasses import dataclass, field

from emberlog.plans.errors import Position

#: Array indices beyond this can't occur.
HUGE_INDEX = 2**62 - 1


@dataclass(frozen=True)
class Path:
    """Field names (str) and array indices (int) in order."""

    segments: tuple[str | int, ...]
    position: Position = field(default=Position(), compare=False)

    @property
    def text(self) -> str:
        """Output name: a.b, items[0]."""
        out = ""
        for s in self.segments:
            out += f"[{s}]" if isinstance(s, int) else (f".{s}" if out else s)
        return out

    @property
    def is_ts(self) -> bool:
        return self.segments == ("ts",)


@dataclass(frozen=True)
class Literal:
    """kind: string, number, duration, bool or null. A duration's value is its text."""

    kind: str
    value: str | int | float | bool | None
    position: Position = field(default=Position(), compare=False)


Operand = Path | Literal


@dataclass(frozen=True)
class Compare:
    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class Match:
    operand: Operand
    pattern: str
    negated: bool
    position: Position = field(default=Position(), compare=False)


@dataclass(frozen=True)
class In:
    path: Path
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Exists:
    path: Path


@dataclass(frozen=True)
class Not:
    inner: Filter


@dataclass(frozen=True)
class And:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Or:
    left: Filter
    right: Filter


Filter = Compare | Match | In | Exists | Not | And | Or


@dataclass(frozen=True)
class Fields:
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class Sort:
    path: Path
    descending: bool
    limit: int


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Aggregate:
    function: str
    path: Path | None

    @property
    def text(self) -> str:
        return f"{self.function}({self.path.text if self.path else ''})"

    @property
    def column(self) -> str:
        """Output name: count, sum_a_b, p95_items_0."""
        return "_".join([self.function, *(str(s) for s in self.path.segments)]) if self.path else self.function


@dataclass(frozen=True)
class Stats:
    functions: tuple[Aggregate, ...]
    by: tuple[Path, ...] = ()
    every: int | None = None  # microseconds


Stage = Fields | Sort | Limit | Stats


@dataclass(frozen=True)
class Query:
    filter: Filter | None
    stages: tuple[Stage, ...]
