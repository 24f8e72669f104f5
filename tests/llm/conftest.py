from __future__ import annotations

import pytest

from bylines.llm.queries import vocabulary

from llm_support import AWKWARD, CLASHING, SCHEMA, SF


@pytest.fixture(scope="session")
def awkward(spark):
    """Missing ids and texts, repeated rows and ids, long texts, long words, and columns with clashing names."""
    rows = [(i, t, "en" if i and i % 2 else None, None, None, *CLASHING) for i, t in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(4).cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def bpe():
    return vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
