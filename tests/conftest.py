from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def curated_rows(spark):
    """Build curated rows from (doi, year, subjareas, auid, position, credit) tuples."""

    def build(*rows):
        schema = (
            "doi string, year int, subjareas array<string>, aunum bigint, auid bigint, surname string,"
            " position int, credit string"
        )
        filled = [(d, y, s, 1, a, f"s{a}", p, c) for d, y, s, a, p, c in rows]
        return spark.createDataFrame(filled, schema)

    return build
