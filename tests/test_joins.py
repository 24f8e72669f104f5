from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bylines.operators.joins import attach_distinct_count, attach_per_key

from support import settings

SPREAD = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def rows(spark):
    data = [("hot", i % 3) for i in range(60)] + [(f"k{i}", i) for i in range(20)] + [(None, 1), (None, 2)]
    return spark.createDataFrame(data + data[:5], "k string, v int")


@pytest.mark.parametrize("salts", [1, 3, 1024])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_equals_plain_join(rows, salts, how):
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).filter("k <> 'k7'")
    got = attach_per_key(rows, stats, ["k"], how=how, salts=salts)
    want = rows.join(stats, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_null_safe_key(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 1, 2), (None, 1, 3), ("a", None, 4)], "k string, y int, v int")
    stats = df.groupBy("k", "y").agg(F.sum("v").alias("s"))
    got = attach_per_key(df, stats, ["k"], null_safe=["y"])
    assert {r["v"]: r["s"] for r in got.collect()} == {1: 5, 2: 2, 3: None, 4: 5}


def test_awkward_column_names(spark):
    df = spark.createDataFrame([("a", 1, 2)], "`k e` string, `_salt v` int, n int")
    stats = df.groupBy("k e").agg(F.max("n").alias("the max"))
    assert [tuple(r) for r in attach_per_key(df, stats, ["k e"]).collect()] == [("a", 1, 2, 2)]


def test_columns_with_the_names_of_helpers(spark):
    df = spark.createDataFrame([("a", 1, 2, 3)], "_key string, _value int, _rows int, `_Salt` int")
    stats = df.groupBy("_key").agg(F.max("_value").alias("__value"))
    got = attach_per_key(df, stats, ["_key"])
    assert got.columns == [*df.columns, "__value"]
    assert [tuple(r) for r in got.collect()] == [("a", 1, 2, 3, 1)]


def test_rows_of_all_hot_keys_are_dealt_evenly(spark):
    """Twenty keys and the rows without one share the data; no partition gets much more than its part."""
    hot = spark.range(0, 20_000, 1, 8).selectExpr("concat('hot', id % 20) AS k", "id AS v")
    none = spark.range(0, 10_000, 1, 8).selectExpr("CAST(NULL AS STRING) AS k", "-id AS v")
    df = hot.union(none)
    stats = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    with settings(spark, **SPREAD):
        joined = attach_per_key(df, stats, ["k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert sum(sizes) == 30_000
    assert len(sizes) == 8
    assert max(sizes) < 1.5 * 30_000 / 8
    assert "Limit" not in plan
    assert "Broadcast" not in plan


def test_distinct_count_of_null_entity_is_null(spark):
    rows = [("a", 1), ("a", 2), ("a", 2), ("a", None), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "doi string, auid int")
    got = attach_distinct_count(df, "doi", "auid", "n").collect()
    assert len(got) == 6
    assert {(r["doi"], r["n"]) for r in got} == {("a", 2), (None, None)}


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shares_of_keys_take_one_shuffle(spark, rows):
    """The rows, the shares by key, the values by key and the values by share; ``stats`` is grouped before."""
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    with settings(spark, **SPREAD):
        assert shuffles(attach_per_key(rows, stats, ["k"])) - shuffles(stats) == 4


def test_values_reach_every_share(spark):
    """Every bit of every mask: all 1,024 shares of a key are met, also where Spark thinks the shares few."""
    df = spark.range(20_000).selectExpr("'hot' AS k", "id AS v")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    attached = attach_per_key(df, stats, ["k"])
    assert attached.filter("n = 20000").count() == 20_000
    assert attached.agg(F.sum("v")).first()[0] == sum(range(20_000))


def test_rows_stay_where_they_were_laid_out(spark, rows):
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    place = "pmod(hash(k), 4)"
    with settings(spark, **SPREAD, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        got = attach_per_key(rows, stats, ["k"], salts=2, place=place, parts=12)
        plan = got._jdf.queryExecution().executedPlan().toString()
        parts = got.selectExpr(f"{place} AS place", "spark_partition_id() AS part").distinct().collect()
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(stats, "k", "left").collect()))
    assert plan.count("12), REPARTITION_BY_NUM") == 2
    assert all(sum(p["place"] == place for p in parts) <= 2 for place in range(4))  # a part per share at most
