"""Watch mode: a query over a stream of lines, whose result is given out after each poll.

With stats, all groups so far are given out each time, from Spark's checkpointed state, and the stages after stats are applied to them.
Without, the new rows are. Durations count from the time of the poll. The guard against too many groups does not apply here: the state
of a stream is kept by its store and not by the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.engine import Result, Settings, apply, run
from emberlog.operators.rows import Rows
from emberlog.plans.nodes import Query, Stats
from emberlog.sources import lines
from emberlog.sources.shared import shared_folder
from emberlog.streaming.tail import tail


def decoded(stream: DataFrame, options: lines.Options) -> Rows:
    """Rows of a stream of lines (line, file, at)."""
    found = stream.select(F.col("line").alias("__line"), F.struct(F.col("file"), F.lit(1).cast("long").alias("block"), F.col("at").alias("id")).alias("__seq"))
    return lines.decoded_rows(found, options.format, options)


def snapshots(stream: DataFrame, query: Query, settings: Settings, options: lines.Options, give: Callable[[Result], None], interval: float = 1.0, checkpoint: str | None = None) -> StreamingQuery:
    """Start a query over a stream; give gets a Result after each poll that brought rows."""
    at = next((k for k, s in enumerate(query.stages) if isinstance(s, Stats)), None)
    head = query if at is None else replace(query, stages=query.stages[: at + 1])
    # sorts and limits hold for a poll's rows, so they wait for the batch
    early = query.stages[:at] if at is not None else query.stages
    simple = all(type(s).__name__ == "Fields" for s in early)
    rows = decoded(stream, options)
    streamed = run(head if simple else replace(query, stages=()), rows, settings, streaming=True)

    def batch(df: DataFrame, _: int) -> None:
        found = replace(streamed, df=df)
        if at is not None and simple:
            found = replace(found, df=df.orderBy("__is_other", "__key"))
            rest = query.stages[at + 1 :]
        else:
            rest = () if simple else query.stages
        for stage in rest:
            found = apply(stage, found, settings)
        if not df.isEmpty():
            give(Result(query, found))

    writer = streamed.df.writeStream.foreachBatch(batch).outputMode("complete" if at is not None and simple else "append")
    return writer.option("checkpointLocation", checkpoint or shared_folder(stream.sparkSession, "watch")).trigger(processingTime=f"{interval} seconds").start()


def watch(spark: SparkSession, query: Query, paths: list[str], args, settings: Settings, stdout, stderr, from_start: bool = False, stop_after: float | None = None) -> int:
    """Run until interrupted; each snapshot goes to stdout."""
    from emberlog import render

    kind = args.format
    if kind == "auto":
        heads = [lines.local_head(p) for p in paths if lines.readable(p)]
        kinds = {lines.detect(h) for h in heads if h}
        kind = kinds.pop() if len(kinds) == 1 else "plain"
    options = lines.Options(kind, args.max_line, args.max_depth, settings.tz)

    def give(result: Result) -> None:
        if not args.quiet and any(isinstance(s, Stats) for s in query.stages):
            print("emberlog: SNAPSHOT", file=stderr)
        for part in render.write(result, args.output):
            stdout.write(part)
        stdout.flush()

    running = snapshots(tail(spark, paths, from_start), query, settings, options, give, args.watch)
    try:
        running.awaitTermination(stop_after) if stop_after else running.awaitTermination()
    except KeyboardInterrupt:
        print("emberlog: interrupted", file=stderr)
    finally:
        running.stop()
    return 130
