"""Shapes that must hold whatever the size of the data."""

from __future__ import annotations

import re

import pytest

from bylines.operators.facts import build_facts
from bylines.operators.metrics import label_share
from bylines.plans import sample_queries, sample_views
from bylines.plans.sample_queries import QUERIES

from support import settings

PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
SF = "/root/testdata/sf0.001"
WRITES = {"a2_csv", "a8_curated_round_trip", *(name for name in QUERIES if name.endswith("_stored"))}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_python_rows_and_no_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def physical(spark, name) -> str:
    with settings(spark, **PLAIN):
        return plan_of(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["b9_stack", "f1_share", "f2_mean_share"])
def test_no_sort_aggregate(spark, name):
    assert "SortAggregate" not in physical(spark, name)


@pytest.mark.parametrize(
    "name", ["d2_year_group", "d6_members_group", "d8_labels_group", "g5_chi2_label", "g7_chi2_group_label"]
)
def test_rows_are_aggregated_before_they_are_opened(spark, name):
    """Every generator of groups or labels stands above an aggregate, so it opens distinct rows or counts."""
    lines = physical(spark, name).splitlines()
    depth = [len(re.match(r"[ :|+\-]*", line)[0]) for line in lines]
    generators = [i for i, line in enumerate(lines) if "Generate explode" in line]
    assert generators
    for i in generators:
        below = [line for line, d in zip(lines[i + 1 :], depth[i + 1 :], strict=True) if d > depth[i]]
        assert any("HashAggregate" in line for line in below)


def test_share_rows_hold_one_list_each(spark, curated_rows):
    df = curated_rows(*[("a", 2020, [f"C{i}"], i, 1, "Software, Resources") for i in range(40)])
    share = label_share(build_facts(df))
    assert share.count() == 80
    assert {r["n"] for r in share.collect()} == {40}
    assert plan_of(share).count("collect_") == 0


def test_facts_read_and_group_their_input_once(spark, curated_rows, tmp_path):
    path = str(tmp_path / "curated")
    curated_rows(("a", 2020, ["MEDI"], 1, 1, "Software"), (None, None, None, 2, 2, "Software")).write.parquet(path)
    with settings(spark, **PLAIN):
        plan = plan_of(build_facts(spark.read.parquet(path)))
    assert len(re.findall("FileScan parquet", plan)) == 1
    assert len(re.findall("ReusedExchange", plan)) == 2
    assert any("_salt" in keys for keys in re.findall(r"SortMergeJoin \[(.*?)\], \[", plan))


@pytest.mark.parametrize("name", [name for name in QUERIES if name.endswith("_scopes")])
def test_overall_and_groups_come_from_one_scan(spark, name):
    """Scans that are left once equal exchanges are shared: those of the query for the groups alone."""
    alone = {"d9": "d10_summary_group_members", "f8": "f9_cooccur_group", "f11": "f12_position_group"}
    alone |= {"f13": "f14_rate_group", "g4": "g6_chi2_group"}
    scans, grouped = (physical(spark, n).count("Scan parquet") for n in (name, alone[name.split("_")[0]]))
    assert scans <= grouped


@pytest.mark.parametrize(("name", "most"), [("b4_unresolved", 38), ("b9_stack", 14), ("b10_complete", 31)])
def test_shuffles_of_the_linkage(spark, name, most):
    assert len(re.findall(r"\bExchange (?:hash|range|Single|Round)", physical(spark, name))) <= most


@pytest.mark.parametrize(("name", "most"), [("b4_unresolved", 18), ("b9_stack", 6), ("b10_complete", 21)])
def test_rounds_of_the_linkage_share_a_shuffle(spark, name, most):
    assert len(re.findall(r"\bExchange (?:hash|range|Single|Round)", physical(spark, name))) <= most


@pytest.mark.parametrize("name", ["b10_complete", "curated"])
def test_rows_of_the_linkage_are_laid_out_once(spark, name):
    laid = [line for line in physical(spark, name).splitlines() if "REPARTITION_BY_NUM" in line]
    assert sum("ReusedExchange" not in line for line in laid) == 1


@pytest.mark.parametrize("name", ["d6_members_group", "d7_labels", "d8_labels_group", "d11_mode"])
def test_more_lines_make_more_parts(spark, monkeypatch, name):
    """6,000 lines in parts of 500; the sizes of papers are counted where the lines lie."""
    whole = physical(spark, name)
    want = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(sample_views, "LINES", 500)
    plan = physical(spark, name)
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, 12\), REPARTITION_BY_NUM", plan)
    assert plan.count("Exchange ") == whole.count("Exchange ")
    assert sorted(map(str, QUERIES[name](spark, SF).collect())) == want


def test_more_lines_make_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(sample_queries, "LINES_PER_BUCKET", 500)
    stored = sample_queries.stored_facts(spark, SF).groupBy("doi").count()
    assert "12 out of 12" in plan_of(stored)


@pytest.mark.parametrize(
    ("name", "parts"),
    [("b3_round1", 12), ("b5_round2", 12), ("b9_stack", 12), ("b4_unresolved", 12), ("b10_complete", 12), ("curated", 37)],
)
def test_more_lines_make_more_parts_of_the_linkage(spark, monkeypatch, name, parts):
    """About 6,000 lines in parts of 500, of the curated table in parts of 166, instead of 8 parts whatever the lines."""
    want = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(sample_views, "LINES", 500)
    laid = re.findall(r"hashpartitioning\(doi#\d+L?, _first#\d+, (\d+)\), REPARTITION_BY_NUM", physical(spark, name))
    assert set(laid) == {str(parts)}
    assert sorted(map(str, QUERIES[name](spark, SF).collect())) == want


def test_stored_facts_are_shuffled_narrow_and_once(spark, monkeypatch):
    """The rows meet the values of their paper where they are written: lists are made after the last shuffle."""
    plans = []
    write = sample_queries.fact_table.write_facts

    def watched(facts, *args, **kwargs):
        with settings(spark, **PLAIN, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
            plans.append(plan_of(facts.select("*")))
        assert kwargs["dealt"]
        write(facts, *args, **kwargs)

    monkeypatch.setattr(sample_queries.fact_table, "write_facts", watched)
    stored = sample_queries.stored_facts(spark, SF)
    want = sample_views.facts(spark, SF, keep_empty=True)
    columns = want.columns
    assert sorted(map(str, stored.select(columns).collect())) == sorted(map(str, want.collect()))
    lines = plans[0].splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    assert not any("Exchange" in line for line in lines[:join])
    assert sum("REPARTITION_BY_NUM" in line and "_place" in line and "_salt" in line for line in lines) == 2
