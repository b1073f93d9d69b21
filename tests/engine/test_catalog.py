"""Registered queries over tables with more groups and values than the samples have."""

import gc
import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlog import catalog
from emberlog.engine import Engine
from emberlog.sources import lines


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Events of 70,000 users, the last of which have two."""
    folder = tmp_path_factory.mktemp("many")
    user = F.when(F.col("id") < 70_000, F.col("id")).otherwise(70_000 - (F.col("id") - 70_000) - 1)
    kind = F.element_at(F.array(F.lit("click"), F.lit("view")), F.when(F.col("id") < 70_000, 1).otherwise(2))
    spark.range(70_020).select(F.col("id").alias("event_id"), user.alias("user_id"), kind.alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_distinct_values_are_counted_to_the_end(spark, many):
    assert [r["line"] for r in catalog.render_csv(spark, many).orderBy("number").collect()] == ["event_type,count,count_distinct_user_id", "click,70000,70000", "view,20,20"]


def test_groups_are_whole(spark, many):
    """The users of most events came last, after more groups than the engine's guard lets through."""
    got = [tuple(r) for r in catalog.QUERIES["stats_topk"](spark, many).collect()]
    assert got == [(k, 2) for k in range(69_980, 69_990)]
    hours = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_interval(hours=F.col("event_id"))
    spark.read.parquet(f"{many}/events.parquet").withColumn("ts", hours).limit(10_050).write.parquet(f"{many}/hours/events.parquet")
    assert catalog.QUERIES["window_1h"](spark, f"{many}/hours").count() == 10_050


def test_groups_over_files_are_made_once(spark, tmp_path):
    """The groups that the guard counted are the result's, however long ago the query was compiled."""
    (tmp_path / "a.log").write_text('{"k":"x"}\n{"k":"y"}\n')
    df = Engine(spark).files("| stats count() by k", [str(tmp_path)]).df
    gc.collect()
    assert "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString()
    assert [tuple(r) for r in df.collect()] == [("x", 1), ("y", 1)]


def test_lines_of_a_file_are_not_dealt_to_one_task(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.log").write_text('{"k":%d}\n' % k)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # else so few lines are sent to the names
    try:
        plan = lines.read(spark, [str(tmp_path)]).rows.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_packed_files_are_of_a_bounded_size(spark, many, monkeypatch):
    monkeypatch.setattr(catalog, "PACKED", 9_000)
    (folder,) = catalog._written(spark, many, x=(F.col("event_id").cast("string"), F.lit(True), True))
    sizes = [len(gzip.decompress(p.read_bytes()).split()) for p in Path(folder).glob("*.gz")]
    assert sum(sizes) == 70_020 and max(sizes) <= 9_000


def test_polls_of_a_stream_have_more_files_and_not_larger_ones(spark, many, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog, "POLLED", 10_000)
    monkeypatch.setattr(catalog, "shared_folder", lambda *_: str(tmp_path))
    assert [tuple(r) for r in catalog.watch_snapshots(spark, many).collect()] == [(0, "click", 69_990, 69_999), (1, "view", 20, 69_999)]
    assert len(list((tmp_path / "lines").glob("*.parquet"))) == 9
    assert len([p for p in (tmp_path / "state/offsets").iterdir() if p.name.isdigit()]) == 3
