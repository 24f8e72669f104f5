"""Distinct counts, sizes per entity, and summaries of their distribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.functions.labels import (
    LOOSE_SEPARATOR,
    ROLE_ALIASES,
    allowed_labels,
    canonical_labels,
    split_labels,
)
from bylines.functions.sql import name as quoted
from bylines.operators.joins import attach_per_key

QUANTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
RANGES = 256  # into which exact ranks cut the values of a group
SUMMARY = ("min", "q1", "median", "mean", "q3", "max", "sd", "mode")


def distinct_by(
    df: DataFrame, keys: Sequence[str], entity: str, name: str = "n", multi: Mapping[str, str] | None = None
) -> DataFrame:
    """Distinct entities per key.

    ``multi`` maps the name of a further key to SQL for an array of its values; a row belongs to
    each. Rows are made distinct with the array, and only what is left is opened.
    """
    if not multi:
        return df.groupBy(*keys).agg(F.count_distinct(entity).alias(name))
    rows = df.selectExpr(*keys, entity, *[f"{array} AS {key}" for key, array in multi.items()]).distinct()
    for key in multi:
        rows = rows.withColumn(key, F.explode(key))
    return distinct_by(rows, [*multi, *keys], entity, name)


def size_per(
    df: DataFrame,
    entity: str,
    member: str,
    name: str,
    by: Sequence[str] = (),
    multi: Mapping[str, str] | None = None,
) -> DataFrame:
    """Distinct members per entity (and group)."""
    return distinct_by(df, [*by, entity], member, name, multi)


def labels_per(
    df: DataFrame,
    entity: str,
    labels: str,
    name: str,
    by: Sequence[str] = (),
    pattern: str = LOOSE_SEPARATOR,
    multi: Mapping[str, str] | None = None,
    vocab: Sequence[str] | None = None,
    aliases: Mapping[str, str] = ROLE_ALIASES,
) -> DataFrame:
    """Distinct labels per entity (and group) of a joined label string.

    Raw labels by default, '' included. With ``vocab`` only its labels count, after ``aliases``
    were replaced, and entities without any are left out. Equal strings are split once.
    """
    found = f"array_distinct(transform({split_labels(labels, pattern)}, x -> trim(x)))"
    if vocab is not None:
        found = f"array_distinct({allowed_labels(canonical_labels(found, aliases), vocab)})"
    groups = {key: f"_{key}" for key in multi or {}}
    arrays = [f"{array} AS _{key}" for key, array in (multi or {}).items()]
    texts = df.selectExpr(*by, entity, labels, *arrays).distinct()
    rows = texts.selectExpr(*by, entity, *groups.values(), f"explode({found}) AS _label")
    return distinct_by(rows, [*by, entity], "_label", name, groups)


def summarise(df: DataFrame, value: str, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """min, q1, median, mean, q3, max, sample sd and mode (ties: smallest) of a value.

    Quantiles are observed values, by default from a mergeable sketch; ``exact`` ranks the values
    instead. The parts are one row per group each and are put together as rows, so that no group,
    however many values it has, ends in one task. ``value`` and ``by`` are column names.
    """
    keys, column = list(map(quoted, by)), quoted(value)
    levels = F.percentile_approx(F.col(column), list(QUANTILES.values()))
    parts = [
        df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd")),
        mode(df, value, by),
        _exact_levels(df, value, by)
        if exact
        else df.groupBy(*keys)
        .agg(levels.alias("_levels"))
        .selectExpr(*keys, *[f"_levels[{i}] AS {q}" for i, q in enumerate(QUANTILES)]),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in SUMMARY])


def ranked_values(df: DataFrame, value: str, by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """Distinct values of each group (struct ``_group``) with rows of that value or less, and of the group.

    ``_value``, ``_upto`` and ``_total``. A sketch of the group cuts its values into ``ranges`` ranges
    of about as many rows each, wherever they lie. What lies before a value is the rows of the ranges
    before its own, one number per range, and the running sum within the range: no task ranks more
    than a range. Values are counted before they are ranked, so repeats don't make a range large.
    NULL and NaN take no part.
    """
    column = quoted(value)
    # Without groups the key is 0 for every row, as an expression: a constant would turn the joins into products.
    keys = list(map(quoted, by)) or [f"pmod(xxhash64({column}), 1)"]
    group = f"struct({', '.join(keys)}) AS _group"
    real = f"{column} IS NOT NULL AND NOT isnan(CAST({column} AS DOUBLE))"
    rows = df.filter(real).selectExpr(group, f"{column} AS _value")
    cuts = F.percentile_approx("_value", [i / ranges for i in range(1, ranges)])
    bounds = rows.groupBy("_group").agg(F.array_distinct(cuts).alias("_bounds"))
    counts = rows.groupBy("_group", "_value").agg(F.count(F.lit(1)).alias("_n"))
    dealt = attach_per_key(counts, bounds, ["_group"]).selectExpr(
        "_group", "_value", "_n", "size(filter(_bounds, b -> b < _value)) AS _range"
    )
    # One row per range: at most ``ranges`` of a group.
    totals = dealt.groupBy("_group", "_range").agg(F.sum("_n").alias("_sum"))
    earlier = "OVER (PARTITION BY _group ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    bases = totals.selectExpr(
        "_group", "_range", f"sum(_sum) {earlier} - _sum AS _before", "sum(_sum) OVER (PARTITION BY _group) AS _total"
    )
    own = "OVER (PARTITION BY _group, _range ORDER BY _value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inside = dealt.selectExpr("_group", "_range", "_value", f"sum(_n) {own} AS _own")
    return inside.join(bases, ["_group", "_range"]).selectExpr("_group", "_value", "_before + _own AS _upto", "_total")


def _exact_levels(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quantiles as the least values that so large a part of the rows doesn't exceed."""
    found = ranked_values(df, value, by).groupBy("_group").agg(
        *[F.expr(f"min(_value) FILTER (WHERE _upto >= _total * {p}D)").alias(q) for q, p in QUANTILES.items()]
    )
    return found.selectExpr(*[f"_group.{quoted(c)} AS {quoted(c)}" for c in by], *QUANTILES)


def mode(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent value; the smallest of those tied, NULL where there is none.

    Equal values are counted first, then the smallest value of each count is taken, and of these the
    one with the largest count: hash aggregates that combine, of fixed width for numbers.
    """
    keys, column = list(map(quoted, by)), quoted(value)
    counts = df.groupBy(*keys, F.col(column).alias("_value")).agg(F.count(column).alias("_n"))
    least = counts.groupBy(*keys, "_n").agg(F.min("_value").alias("_value"))
    return least.groupBy(*keys).agg(F.max_by("_value", "_n").alias(name))
