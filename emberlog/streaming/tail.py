"""A streaming source of the lines appended to files.

The offset of the stream has each file's identity and the number of bytes read. A file that is new at the first poll is taken from its end
on (or from its start, with the option from_start). A file that is replaced, that comes back, or that shrinks is read from its start
again; one that is missing is no error. Only whole lines are read: the offset stays behind the last line end, so an unfinished line
waits for its rest. The files must be readable where the source runs, on the driver's host.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Bytes of a file that a poll takes at most, but for a longer line; the next poll goes on behind them.
POLL = 64 << 20
SCHEMA = "line string, file int, at long"


def state(path: str) -> tuple[int, int] | None:
    """Identity and size of a file; None if it isn't there."""
    try:
        found = os.stat(path)
    except OSError:
        return None
    return found.st_ino, found.st_size


def advance(path: str, before: list | None, fresh_from_start: bool) -> tuple[list[tuple[bytes, int]], list | None]:
    """Whole lines behind an offset [identity, bytes] with their places, and the offset after them."""
    now = state(path)
    if now is None:
        return [], before and [before[0], 0, True]
    identity, size = now
    if before is None:
        start = 0 if fresh_from_start else size
    elif before[0] != identity or size < before[1] or len(before) > 2:
        start = 0
    else:
        start = before[1]
    if start >= size:
        return [], [identity, start]
    with open(path, "rb") as f:
        f.seek(start)
        body = f.read(min(POLL, size - start))
        while b"\n" not in body and len(body) < size - start:  # a line longer than that
            body += f.read(min(len(body), size - start - len(body)))
    end = body.rfind(b"\n") + 1
    lines, at = [], start
    for line in body[:end].split(b"\n")[:-1]:
        lines.append((line, at))
        at += len(line) + 1
    return lines, [identity, start + end]


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, paths: list[str], from_start: bool):
        self.paths, self.from_start = paths, from_start

    def initialOffset(self) -> dict:
        at = {}
        for p in self.paths:
            now = state(p)
            at[p] = None if now is None else [now[0], 0 if self.from_start else now[1]]
        return {"files": json.dumps(at)}

    def _between(self, start: dict) -> tuple[list[tuple], dict]:
        before = json.loads(start["files"])
        rows, after = [], {}
        for number, p in enumerate(self.paths):
            # a file that wasn't there at first is read from its start when it comes
            lines, after[p] = advance(p, before.get(p), True)
            rows += [(line.decode("utf-8", "replace"), number, at) for line, at in lines]
        return rows, {"files": json.dumps(after)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._between(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again after a failure: those up to the places of end, as far as the files still have them."""
        rows, _ = self._between(start)
        ends = json.loads(end["files"])
        return iter([r for r in rows if ends.get(self.paths[r[1]]) and r[2] < ends[self.paths[r[1]]][1]])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Format emberlog_tail; options: paths (a JSON list), from_start."""

    @classmethod
    def name(cls) -> str:
        return "emberlog_tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(json.loads(self.options["paths"]), self.options.get("from_start", "false") == "true")


def tail(spark: SparkSession, paths: list[str], from_start: bool = False):
    """Streaming DataFrame of appended lines: line, file (number of its path), at (place of the line in the file)."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("emberlog_tail").option("paths", json.dumps([os.path.abspath(p) for p in paths])).option("from_start", str(from_start).lower()).load()
