"""Connected components of an edge table, on the executors, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm import frames


def components(edges: DataFrame) -> DataFrame:
    """node and label (its component's smallest node) of every node of edges (a, b); loops and repeated edges may occur.

    Each round gives the nodes a random order of its own, hangs each node below the first of itself and its neighbours, and puts the
    nodes hung below in the place of their children; loops and repeated edges go. A node of degree d stays with probability 1 / (d + 1)
    at most, so the nodes that still have edges halve at least in expectation, whatever the graph and its numbering, and all rounds
    together handle a small multiple of the edges. At the end names return down the rounds. Tables of a round are written in the shared
    folder; only a flag comes to the driver.
    """
    edges = frames.staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or edges.limit(1).take(1):
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)), F.col(c).alias("node"))  # noqa: B023, E731
        ways = F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.least(order("a"), order("b")).alias("first")) for x in ("a", "b")]))
        first = edges.select(ways.alias("way")).groupBy(F.col("way.node").alias("node")).agg(F.min("way.first").alias("first"))
        parents = frames.staged(first.select("node", F.col("first.node").alias("parent")), "parents")
        rounds.append(parents)
        one = edges.join(parents, edges["a"] == parents["node"]).select(F.col("parent").alias("a"), "b")
        two = one.join(parents, one["b"] == parents["node"]).select("a", F.col("parent").alias("b")).filter("a <> b")
        edges = frames.staged(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = rounds.pop().withColumnRenamed("parent", "label")
    while rounds:
        upper = labels.withColumnRenamed("node", "parent")
        labels = frames.staged(rounds.pop().join(upper, "parent", "left").select("node", F.coalesce("label", "parent").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return labels.join(least, "label").select("node", F.col("least").alias("label"))
