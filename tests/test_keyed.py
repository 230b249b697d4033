"""Building blocks for hot keys give the results of the plain forms."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftline.operators.keyed import (
    best_with_ties,
    latest_per_key,
    skew_safe_join,
    top_k_per_key,
    with_first_position,
    with_previous_row,
)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def facts(spark):
    random.seed(7)
    rows = [(i, None if i % 17 == 0 else (1 if i % 3 == 0 else i % 40)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, key long")


def test_previous_row_equals_lag(spark):
    random.seed(3)
    rows = [(random.randrange(4), random.randrange(300), i, random.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "key long, t long, id long, x double")
    got = with_previous_row(df, ["key"], ["t", "id"], F.floor(F.col("t") / 25), ["x"])
    lag = F.lag("x").over(Window.partitionBy("key").orderBy("t", "id"))
    assert rows_of(got.select("id", F.col("previous.x").alias("p"))) == rows_of(df.select("id", lag.alias("p")))


def test_first_position(spark):
    df = facts(spark).dropna()
    least = F.min("id").over(Window.partitionBy("key"))
    assert rows_of(with_first_position(df, ["key"], "id", "first").select("id", "first")) == rows_of(
        df.select("id", least.alias("first"))
    )


def test_latest_and_top_k(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 3, 1), ("a", 4, 2)], "key string, id int, v int")
    latest = latest_per_key(df, ["key"], [F.col("v").desc(), F.col("id").desc()])
    assert sorted(r["id"] for r in latest.collect()) == [2, 3]
    assert sorted(r["id"] for r in top_k_per_key(df, ["key"], [F.col("v").desc(), F.col("id")], 1).collect()) == [1, 3]
    assert sorted(r["id"] for r in best_with_ties(df, ["key"], "v", 1).collect()) == [1, 2, 3]


def test_best_with_ties_equals_rank(spark):
    random.seed(9)
    rows = [(random.randrange(3), random.randrange(6), i) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, v long, id long")
    for k in (1, 3, 50):
        window = Window.partitionBy("key").orderBy(F.col("v").desc())
        want = df.withColumn("rank", F.rank().over(window)).where(F.col("rank") <= k)
        names = ["key", "v", "id", "rank"]
        assert rows_of(best_with_ties(df, ["key"], "v", k).select(*names)) == rows_of(want.select(*names))


@pytest.mark.parametrize("hot", ["key = 1", "key IS NULL"])
@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_hot_key_is_split_by_its_size(spark, hot, how):
    """Half of all rows have one key; the lookup side is not broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot_value = "1" if "1" in hot else "cast(null as bigint)"
        left = spark.range(0, 60_000, numPartitions=8).selectExpr(
            "id", f"if(id % 2 = 0, {hot_value}, id % 400) as key", "repeat('x', 20) as more"
        )
        right = spark.range(200).selectExpr("id * 2 + 1 as key", "concat('v', id) as text")
        joined = skew_safe_join(left, right, ["key"], how)
        plain = left.join(right, "key", how)
        assert joined.groupBy("key").count().orderBy("key").collect() == plain.groupBy("key").count().orderBy("key").collect()
        if how == "left":
            rows = joined.withColumn("task", F.spark_partition_id())
            hot_key = 1 if "1" in hot else None
            assert len({r["task"] for r in rows.collect() if r["key"] == hot_key}) > 1
            assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_joins_that_cannot_be_split_are_refused(spark):
    with pytest.raises(ValueError):
        skew_safe_join(spark.range(2), spark.range(2), ["id"], "right")
