"""A log of parcel depots made from row numbers and a seed: the same rows on any cluster, in any order of execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, STEP = 1_712_345_678_000, 370
DEPOTS = ("north", "harbour", "mill", "airfield", "old town")
NOTES = ("parcel scanned", "label unreadable", "van is late", "left with a neighbour", "address unknown")
DRIVERS = 7_000


def rows(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n rows: id, ts (epoch milliseconds), level, depot, lane, grams, minutes, driver, note."""

    def draw(salt: int, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(below))

    def pick(salt: int, values: tuple[str, ...]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), draw(salt, len(values)).cast("int"))

    share = draw(1, 40)
    level = F.when(share < 22, "info").when(share < 33, "debug").when(share < 38, "warn").otherwise("error")
    return spark.range(n).select(
        "id", (F.lit(START) + F.col("id") * STEP + draw(3, STEP)).alias("ts"), level.alias("level"), pick(4, DEPOTS).alias("depot"), draw(5, 12).alias("lane"),
        draw(6, 31_500).alias("grams"), draw(7, 240).alias("minutes"), F.format_string("driver-%d", draw(8, DRIVERS)).alias("driver"), pick(9, NOTES).alias("note"),
    )


def lines(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """The rows as JSON lines (line), with their number (id)."""
    columns = ("ts", "level", "depot", "lane", "grams", "minutes", "driver", "note")
    return rows(spark, n, seed).select("id", F.to_json(F.struct(*columns)).alias("line"))
