from pyspark.sql import functions as F

from emberlog.engine import Engine
from emberlog.sources import synthetic


def test_rows_depend_on_the_seed_alone(spark):
    one = synthetic.rows(spark, 500, 3).collect()
    assert one == synthetic.rows(spark, 500, 3).repartition(7).orderBy("id").collect() and one != synthetic.rows(spark, 500, 4).collect()
    shares = {r["level"]: r["count"] for r in synthetic.rows(spark, 20_000).groupBy("level").count().collect()}
    assert shares["info"] > shares["debug"] > shares["warn"] > shares["error"] > 400


def test_lines_and_columns_agree_at_any_parallelism(spark):
    query = 'level >= "warn" | stats count(), sum(grams), avg(minutes), p95(minutes), min(driver), count_distinct(driver) by depot, lane every 1h | sort count desc limit 12'
    found = []
    for parts in ("1", "6"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        typed = Engine(spark).table(query, synthetic.rows(spark, 3000), ("id",)).df.collect()
        text = Engine(spark).lines(query, synthetic.lines(spark, 3000), "line", "id").df
        text = text.withColumn("lane", F.col("lane").cast("long")).withColumn("sum_grams", F.col("sum_grams").cast("long")).withColumn("p95_minutes", F.col("p95_minutes").cast("long")).collect()
        found += [[tuple(r) for r in typed], [tuple(r) for r in text]]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found[0]) == 12 and all(f == found[0] for f in found)


def test_many_groups_under_the_guard(spark):
    rows = synthetic.rows(spark, 4000)
    out = Engine(spark).table("| stats count() by driver", rows, ("id",), max_groups=100).df
    assert out.count() == 101 and out.agg(F.sum("count")).collect()[0][0] == 4000
