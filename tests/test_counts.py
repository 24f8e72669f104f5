from __future__ import annotations

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from bylines.operators.counts import RANGES, distinct_by, labels_per, mode, ranked_values, size_per, summarise

from support import settings


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(v,) for v in [3, 1, 3, 1, 2]], "v int")
    assert [r["mode"] for r in mode(df, "v").collect()] == [1]
    for exact in (False, True):
        assert summarise(df, "v", exact=exact).head()["mode"] == 1


@pytest.mark.parametrize("exact", [False, True])
def test_summary(spark, exact):
    rng = random.Random(1)
    values = {g: [rng.randint(1, 9) for _ in range(n)] for g, n in (("a", 40), ("b", 101), ("c", 1))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v int")
    for r in summarise(df, "v", ["g"], exact=exact).collect():
        vs = sorted(values[r["g"]])
        at = [vs[max(0, -(-len(vs) * k // 4) - 1)] for k in range(5)]
        assert [r[c] for c in ("min", "q1", "median", "q3", "max")] == at
        assert r["mean"] == pytest.approx(statistics.mean(vs))
        assert r["sd"] == (pytest.approx(statistics.stdev(vs)) if len(vs) > 1 else None)


def test_raw_labels_are_counted(spark):
    df = spark.createDataFrame([("a", "x,  y ,x"), ("a", "y,z"), ("b", ""), ("c", None)], "eid string, credit string")
    assert {r["eid"]: r["n"] for r in labels_per(df, "eid", "credit", "n").collect()} == {"a": 3, "b": 1}


def test_distinct_counts(spark):
    rows = [("a", 1, 2020), ("a", 1, 2020), ("a", 2, 2021), ("b", None, 2021)]
    df = spark.createDataFrame(rows, "eid string, auid int, y int")
    assert {r["y"]: r["n"] for r in distinct_by(df, ["y"], "eid").collect()} == {2020: 1, 2021: 2}
    assert {r["eid"]: r["n"] for r in size_per(df, "eid", "auid", "n").collect()} == {"a": 2, "b": 0}


def test_summary_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "g string, v int")
    for exact in (False, True):
        (row,) = summarise(df.filter("g = 'c'"), "v", exact=exact).collect()
        assert set(row) == {None}
        rows = {r["g"]: (r["max"], r["mode"]) for r in summarise(df, "v", ["g"], exact=exact).collect()}
        assert rows == {"a": (None, None), "b": (2, 2)}


def test_summary_of_many_values_has_no_single_task(spark):
    """Two million levels, negative ones and a group key of NULL; only totals of buckets meet in one place."""
    df = spark.range(0, 2_000_000, 1, 8).selectExpr("CAST(NULL AS STRING) AS g", "id - 1000000 AS v")
    row = summarise(df, "v", ["g"], exact=True).head()
    assert [row[c] for c in ("min", "q1", "median", "q3", "max")] == [-1000000, -500001, -1, 499999, 999999]
    assert row["mode"] == -1000000
    with settings(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for frame in (summarise(df, "v", exact=True), summarise(df, "v"), mode(df, "v")):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            # Whatever meets in one partition was aggregated before.
            for below in re.findall(r"Exchange SinglePartition.*\n[ :|+-]*(?:\*\(\d+\) )?(\w+)", plan):
                assert below.endswith("Aggregate")
            assert "CartesianProduct" not in plan
            assert "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["n", "s", "x y", "_value", "_n"])
def test_any_column_name(spark, name):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], f"`g h` string, `{name}` int")
    for exact in (False, True):
        rows = summarise(df, name, ["g h"], exact=exact).collect()
        assert {r["g h"]: (r["min"], r["max"], r["mode"]) for r in rows} == {"a": (1, 3, 1), "b": (2, 2, 2)}


def test_exact_quantiles_of_many_distributions(spark):
    rng = random.Random(6)
    values = {
        "narrow": [10**9 + rng.randint(0, 400) for _ in range(2000)],
        "wide": [rng.randint(-(10**18), 10**18) for _ in range(1500)],
        "hot": [5] * 1500 + [rng.randint(0, 10) for _ in range(500)],
        "one": [7],
    }
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v bigint").repartition(5)
    for r in summarise(df, "v", ["g"], exact=True).collect():
        vs = sorted(values[r["g"]])
        assert [r[c] for c in ("min", "q1", "median", "q3", "max")] == [
            vs[max(0, -(-len(vs) * k // 4) - 1)] for k in range(5)
        ]


def test_ranks_of_a_narrow_range_are_dealt_evenly(spark):
    """Three million values within a thousandth of each other: no range holds more than a few parts in a hundred."""
    df = spark.range(10**9, 10**9 + 3_000_000, 1, 8).withColumnRenamed("id", "n")
    ranked = ranked_values(df, "n")
    assert ranked.filter("_upto <> _value - 999999999 OR _total <> 3000000").count() == 0
    cuts = df.selectExpr(f"percentile_approx(n, array({', '.join(str(i / RANGES) + 'D' for i in range(1, RANGES))})) AS c")
    sizes = df.crossJoin(cuts).groupBy(F.expr("size(filter(c, b -> b < n))")).count().agg(F.max("count")).head()[0]
    assert sizes < 3_000_000 / RANGES * 2
    with settings(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for frame in (mode(df, "n"), mode(df.withColumn("g", F.col("n") % 3), "n", ["g"])):
            assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_several_groups_of_a_row(spark):
    rows = [("a", 1, ["x", "y"], "p, q"), ("a", 2, ["x"], "q"), ("a", 1, ["x", "y"], "p, q"), ("b", 3, [], "p")]
    df = spark.createDataFrame(rows, "eid string, auid int, g array<string>, credit string")
    sizes = {(r["f"], r["eid"]): r["n"] for r in size_per(df, "eid", "auid", "n", multi={"f": "g"}).collect()}
    assert sizes == {("x", "a"): 2, ("y", "a"): 1}
    labels = {(r["f"], r["eid"]): r["n"] for r in labels_per(df, "eid", "credit", "n", multi={"f": "g"}).collect()}
    assert labels == {("x", "a"): 2, ("y", "a"): 2}


def test_allowed_labels_only(spark):
    df = spark.createDataFrame([("a", "x, old, z"), ("a", "new"), ("b", "z")], "eid string, credit string")
    got = labels_per(df, "eid", "credit", "n", vocab=["x", "new"], aliases={"old": "new"}).collect()
    assert [(r["eid"], r["n"]) for r in got] == [("a", 2)]
