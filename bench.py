"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import io
import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberlog import cli  # noqa: E402
from emberlog.engine import Engine  # noqa: E402
from emberlog.sources.lines import Options  # noqa: E402

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    events, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem"))
    folder = tempfile.mkdtemp(prefix="bench-")
    body = F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "user_id", "event_type", "value"))
    events.repartition(int(cpus)).select(body.alias("value")).write.mode("overwrite").text(f"{folder}/lines")
    files = sorted(os.path.join(folder, "lines", f) for f in os.listdir(f"{folder}/lines") if f.startswith("part-"))
    aggregate = "| stats count(), avg(value), p95(value) by event_type"
    jsonl = Options(format="jsonl")

    def whole(result) -> None:
        result.df.write.format("noop").mode("overwrite").save()

    def matches(result) -> None:
        result.rows.df.select("__line").write.format("noop").mode("overwrite").save()

    def command(*args: str) -> None:
        """The command line as users run it: scan, renderer and counters."""
        code = cli.main(["-f", "jsonl", *args, *files], io.BytesIO(), io.BytesIO(), io.StringIO(), spark)
        assert code == 0, code

    queries = {
        "filter": lambda: whole(engine.table("value >= 100 and value < 200", events, ("event_id",))),
        "aggregate": lambda: whole(engine.table(aggregate, events, ("event_id",))),
        "high_cardinality": lambda: whole(engine.table("| stats count(), avg(l_extendedprice) by l_orderkey", lineitem, ("l_orderkey", "l_linenumber"), max_groups=None)),
        "top_k": lambda: whole(engine.table("| stats count() by l_partkey | sort count desc limit 10", lineitem, ("l_orderkey", "l_linenumber"), max_groups=None)),
        "window": lambda: whole(engine.table("| stats count(), max(value) by event_type every 1h", events, ("event_id",))),
        "text_filter": lambda: matches(engine.files("value >= 100 and value < 200", files, jsonl)),
        "text_aggregate": lambda: whole(engine.files(aggregate, files, jsonl)),
        "cli_filter": lambda: command("value >= 100 and value < 200"),
        "cli_aggregate": lambda: command(aggregate),
        "cli_limit": lambda: command("value >= 100 | limit 100"),
    }
    took = {}
    for name, query in queries.items():
        times = []
        for _ in range(RUNS + 1):  # the first run compiles
            start = time.perf_counter()
            query()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "total of median query seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
