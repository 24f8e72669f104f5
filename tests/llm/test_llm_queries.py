"""Registered queries against their SQL, and the pipeline against the same steps one by one."""

from __future__ import annotations

import re

import duckdb
import pytest

import corpus_pipeline
from bylines.llm import toxicity
from bylines.llm.common import shared_folder
from bylines.llm.queries import HELD_OUT_TOXICITY, ORACLE, QUERIES

from llm_support import SF
from test_llm_dedup import fingerprint, groups_by_text, near_classes
from test_llm_text import hits


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert sorted(repr([row[c] for c in columns]) for row in df.collect()) == want


def test_one_query_per_operator():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", ["op7_exact_dedup", "op8_license_scan", "op11_source_mixing"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_equals_its_steps(spark, documents, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(documents, labels, learnable=f"NOT ({HELD_OUT_TOXICITY})")
    left = {
        r["doc_id"]: texts[r["doc_id"]]
        for r in toxicity.score_texts(documents, model).collect()
        if r["score"] < toxicity.THRESHOLD
    }
    left = {g[0]: left[g[0]] for g in groups_by_text(sorted(left.items())) if g[3]}
    prints = {i: fingerprint(t) for i, t in left.items()}
    classes = near_classes(prints.values())
    least = {}
    for i in sorted(left):
        least.setdefault(classes[prints[i]], i)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i for i in least.values() if not hits(left[i], items)[4]}
    assert 0 < len(want) < len(texts)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == want


def test_stages_keep_the_columns(spark, documents, nothing):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, nothing, SF).count() == 0


def test_shared_folder_follows_the_setting(spark):
    assert spark.conf.get("spark.checkpoint.dir") in shared_folder(spark)
