"""The stored fact table: layout, metrics without a shuffle by entity, and replacing a period."""

from __future__ import annotations

import re
from pathlib import Path
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from bylines.operators import metrics as M
from bylines.operators.facts import build_facts, with_position_class
from bylines.sources import fact_table

from support import settings

PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
BUCKETS = 4


@pytest.fixture
def facts(curated_rows):
    rows = [
        (f"d{i}", 2020 + i % 3, ["HEALTH" if i % 2 else "MULT", "C"], j, j, "Software, Resources" if j % 2 else "Software")
        for i in range(60)
        for j in range(1, 4)
    ]
    rows += [(None, 2020, [], 1, 1, "Software"), ("late", None, None, 1, 1, "Software")]
    return with_position_class(build_facts(curated_rows(*rows), keep_empty=True))


@pytest.fixture
def stored(spark, facts, tmp_path):
    table, path = f"facts_{uuid4().hex}", str(tmp_path / "facts")
    fact_table.write_facts(facts, table, path, buckets=BUCKETS, writers=2)
    yield table, path
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def rows(df):
    found = df.select(*sorted(df.columns)).collect()
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in row]) for row in found)


def test_reads_what_was_written(spark, facts, stored):
    assert rows(fact_table.read_facts(spark, *stored, buckets=BUCKETS)) == rows(facts)


def test_bucket_is_the_writers(spark, stored):
    table = spark.table(stored[0]).selectExpr("doi", "input_file_name() AS file")
    for r in table.withColumn("b", fact_table.bucket_of("doi", BUCKETS)).collect():
        assert int(re.search(r"_(\d+)\.c\d+", r["file"])[1]) == r["b"]


@pytest.mark.parametrize(
    "metric",
    [
        M.label_share,
        M.mean_labels,
        M.to_entities,
        lambda f: M.count_by_group(M.to_entities(f)),
        lambda f: M.bin_share(M.to_entities(f)),
        lambda f: M.mean_share(M.label_share(f)),
        lambda f: f.groupBy("doi").agg(F.max("row_count"), F.max("position_max"), F.count("*")),
    ],
)
def test_metrics_do_not_shuffle_by_entity(spark, facts, stored, metric):
    with settings(spark, **PLAIN):
        found = metric(fact_table.read_facts(spark, *stored, buckets=BUCKETS))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*doi#", plan)
    assert rows(found) == rows(metric(facts))


def test_replacing_a_period_leaves_the_others(spark, facts, stored):
    table, path = stored

    def files():
        return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}

    before = files()
    changed = facts.filter("year = 2021").withColumn("surname", F.lit("new"))
    fact_table.replace_periods(changed, table, buckets=BUCKETS)
    kept = {f for f in before if not f.startswith("year=2021")}
    assert kept == {f for f in files() if not f.startswith("year=2021")}
    assert not before & {f for f in files() if f.startswith("year=2021")}
    want = facts.filter("year IS NULL OR year <> 2021").unionByName(changed)
    assert rows(spark.table(table)) == rows(want)


def test_another_session_registers_the_table(spark, facts, stored):
    table, path = stored
    schema = spark.table(table).schema
    spark.sql(f"DROP TABLE {table}")
    fact_table.register_facts(spark, table, path, schema, buckets=BUCKETS)
    again = fact_table.read_facts(spark, table, path, buckets=BUCKETS)
    assert rows(again) == rows(facts)
    with settings(spark, **PLAIN):
        plan = again.groupBy("doi").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_one_large_entity_is_written_and_read_by_many_tasks(spark, tmp_path):
    table, path = f"facts_{uuid4().hex}", str(tmp_path / "hot")
    df = spark.range(0, 40_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'hot', concat('d', id)) AS doi", "CAST(2020 AS INT) AS year", "id AS auid"
    )
    fact_table.write_facts(df, table, path, buckets=32, writers=4)
    assert len([f for f in Path(path).rglob("*.parquet")]) > 32
    assert fact_table.unevenness(spark.table(table), "doi", 32) > 8
    read = fact_table.read_facts(spark, table, path, buckets=32)
    assert read.count() == 40_000
    assert "Bucketed: true" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.groupBy("doi").count().filter("doi = 'hot'").head()["count"] == 13_334
    spark.sql(f"DROP TABLE {table}")
