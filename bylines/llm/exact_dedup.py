"""Exact duplicates by skew-safe combining, in built-in functions only.

1. Equal texts of a partition are combined before anything is shuffled (partial aggregate).
2. What is left meets by digest and salt, so that the copies of one text, however many, are dealt
   over ``salts`` tasks.
3. The winners of the salts, at most ``salts`` per text, are combined by digest.

Every stage groups by the whole text beside its digest, so texts are equal only if their content
is. Rows are told their group afterwards by SHA-256, a second hash and the length of their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import SALTS, attach, checkpointed, one_of_each, repeated, share
from bylines.operators.joins import unused

SPACE = r"[\x20\x09-\x0D]+"
KEY = "struct(digest, xxhash64(_text) AS second, length(_text) AS length)"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    """White space runs as one space; NULL as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept for every row of ``docs``.

    Texts are equal if they are identical once each run of white space is one space; NULL counts as
    empty. Of equal texts the row with the smallest id is kept. Rows without id are kept only if no
    equal text has an id. A row that repeats both id and text is the same document and has the same
    result. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return repeated(_grouped(docs, id_col, text_col, salts, digest), "copies")


def _grouped(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """The columns of ``exact_groups``, and ``copies``: rows that repeat id and text are one."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("_text")
    ).select("doc_id", "_text", digest(F.col("_text")).alias("digest"))
    salted = (
        rows.withColumn("_salt", share(F.col("doc_id"), salts))
        .groupBy("digest", "_salt", "_text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    groups = (
        salted.groupBy("digest", "_text")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .selectExpr("digest", f"{KEY} AS _key", "keep_id", "group_size")
    )
    # The texts are combined once, here; what is kept of a group is small.
    groups = checkpointed(groups.drop("digest"))
    apart = rows.selectExpr("doc_id", "digest", f"{KEY} AS _key").groupBy("doc_id", "digest", "_key")
    apart = apart.agg(F.count(F.lit(1)).alias("copies"))
    found = attach(apart, groups, "_key", "doc_id", salts)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", "digest", "keep_id", "group_size", kept, "copies")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of ``docs`` per text, with all its columns: the row with the smallest id.

    Of rows that repeat id and text, and of the rows with a text none of which has an id, one stays,
    whichever of them. An empty table gives no rows. Columns may have any names.
    """
    number, digest, copies = unused(["_id", "_digest", "_copies"], docs.columns)
    kept = _grouped(docs, id_col, text_col, salts, sha256).filter("kept")
    kept = kept.select(F.col("doc_id").alias(number), F.col("digest").alias(digest), F.col("copies").alias(copies))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(number)) & (sha256(normalised(F.col(f"`{text_col}`"))) == F.col(digest))
    return one_of_each(docs.join(kept, same), [number, digest], copies).drop(number, digest, copies)
