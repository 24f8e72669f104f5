"""Pairwise co-occurrence of labels in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.functions.groups import DISCIPLINES
from bylines.functions.labels import ROLES
from bylines.functions.sql import array, literals
from bylines.operators.metrics import tally


def cooccurrence(
    facts: DataFrame,
    labels: str = "credit",
    vocab: Sequence[str] = ROLES,
    by: str | None = None,
    groups: Sequence[str] = tuple(DISCIPLINES),
) -> DataFrame:
    """For each pair of vocabulary labels: rows with either, with both, and their ratio.

    Rows are counted by label set first. Only the distinct sets are opened into label
    pairs, the pair (a, a) standing for the rows with a, so the generator works on at
    most 2^labels sets and rows with either follow as n(a) + n(b) - both. Pairs that never
    occur appear with zeros and a NULL ratio; with ``by`` (an array column of groups,
    a row belonging to each) so do all pairs of every group of ``groups``.
    """
    held = f"array_intersect({array(vocab)}, {labels}) AS _set"
    keys = [by] if by else []
    sets = tally(facts.selectExpr(held, *keys), ["_set", *keys], name="_n")
    if by:
        sets = sets.withColumn(by, F.explode(by))
    pairs = (
        "flatten(transform(_set, (a, i) -> transform(slice(_set, i + 1, size(_set)),"
        " b -> named_struct('a', a, 'b', b))))"
    )
    # At most labels * (labels + 1) / 2 entries per table, whatever the data.
    tables = (
        sets.selectExpr(*keys, "_n", f"explode({pairs}) AS _pair")
        .groupBy(*keys, "_pair")
        .agg(F.sum("_n").alias("_n"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("_pair", "_n"))).alias("_counts"))
    )
    if by:
        every_group = facts.sparkSession.range(1).selectExpr(f"explode({array(groups)}) AS {by}")
        tables = every_group.join(tables, by, "left")
    grid = ", ".join(f"struct({literals(pair)})" for pair in combinations(vocab, 2))
    one, other, both = (
        f"coalesce(try_element_at(_counts, named_struct('a', {a}, 'b', {b})), 0L)"
        for a, b in (("element1", "element1"), ("element2", "element2"), ("element1", "element2"))
    )
    return (
        tables.selectExpr(*keys, "_counts", f"inline(array({grid})) AS (element1, element2)")
        .selectExpr(*keys, "element1", "element2", f"{one} + {other} - {both} AS either", f"{both} AS both")
        .selectExpr("*", "try_divide(both, either) AS ratio")
    )
