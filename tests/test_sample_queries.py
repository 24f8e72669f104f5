"""Every registered query against the same query as direct SQL in DuckDB."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from bylines.plans.sample_oracle import ORACLE
from bylines.plans.sample_queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.skipif(not Path(SF).exists(), reason="sample tables not present")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    result = duck.execute(ORACLE[name])
    named = [d[0] for d in result.description]
    assert sorted(named) == columns
    want = [tuple(row[named.index(c)] for c in columns) for row in result.fetchall()]
    assert want
    assert ordered(got) == ordered(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_point_lists_every_sample_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="sample tables not present")
def test_entry(spark):
    assert entry.entry(spark).count() == 42


@pytest.mark.parametrize("rest", [(), ("corpus_pipeline.py",), ("corpus_pipeline.py", "bylines/llm/__pycache__/x.pyc")])
def test_entry_point_without_the_text_operators(tmp_path, rest):
    home = Path(entry.__file__).parent
    shutil.copytree(home / "bylines", tmp_path / "bylines", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    for name in rest:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("from bylines.llm import exact_dedup\n")
    listed = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", listed], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert [set(line.split()) for line in done.stdout.splitlines()] == [set(QUERIES), set(ORACLE)]
