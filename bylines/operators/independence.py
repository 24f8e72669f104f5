"""Contingency tables and chi-square tests of independence, from aggregated counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.functions.chi2 import chi2_tail
from bylines.operators.metrics import tally


def participation(
    facts: DataFrame,
    keep: Sequence[str] = ("doi", "auid", "discipline", "position2"),
    labels: str = "credit",
    entity_labels: str = "paper_credit",
) -> DataFrame:
    """Each member crossed with the labels of its entity; ``held`` is 1 if it holds the label."""
    return facts.select(*keep, labels, F.explode(entity_labels).alias("label")).selectExpr(
        *keep, "label", f"CAST(array_contains({labels}, label) AS INT) AS held"
    )


def contingency(
    df: DataFrame,
    row: str,
    col: str,
    by: Sequence[str] = (),
    multi: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Counts of every row value with every column value present (in the same group).

    ``multi`` is an array column of groups, a row belonging to each. Cells that do not
    occur get 0; NULL values take no part. A row counts ``weight`` times. Rows are counted before a table is put together,
    so a table holds one entry per cell: ``row`` and ``col`` are categories.
    """
    known = df.filter(f"{row} IS NOT NULL AND {col} IS NOT NULL")
    keys = [*([multi] if multi else []), *by]
    return (
        tally(known, [*by, row, col], multi, "_n", weight)
        .groupBy(*keys)
        .agg(
            F.collect_set(row).alias("_rows"),
            F.collect_set(col).alias("_cols"),
            F.map_from_entries(F.collect_list(F.struct(F.struct(row, col), "_n"))).alias("_cells"),
        )
        .selectExpr(*keys, "_cols", "_cells", f"explode(_rows) AS {row}")
        .selectExpr(*keys, "_cells", row, f"explode(_cols) AS {col}")
        .selectExpr(*keys, row, col, f"coalesce(try_element_at(_cells, struct({row}, {col})), 0L) AS n")
    )


def with_expected(cells: DataFrame, row: str, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the count expected under independence: row total * column total / total."""
    keys = [*by] or ["0"]
    of_row, of_col, total = (
        f"sum(n) OVER (PARTITION BY {', '.join(k)})" for k in ([*keys, row], [*keys, col], keys)
    )
    return cells.selectExpr("*", f"CAST({of_row} AS DOUBLE) * {of_col} / {total} AS expected")


def chi_square(
    cells: DataFrame, row: str, col: str, by: Sequence[str] = (), yates: bool = True
) -> DataFrame:
    """Statistic, degrees of freedom and p-value of each contingency table.

    A table with a single row or column has no test: statistic and p-value are NULL.
    ``yates`` applies the continuity correction at one degree of freedom.
    """
    # The corrected deviation moves towards zero by at most one half.
    corrected = "greatest(abs(n - expected) - 0.5, 0)" if yates else "(n - expected)"
    return (
        with_expected(cells, row, col, by)
        .groupBy(*by)
        .agg(
            F.expr("sum(pow(n - expected, 2) / expected)").alias("_plain"),
            F.expr(f"sum(pow({corrected}, 2) / expected)").alias("_corrected"),
            F.expr(f"(size(collect_set({row})) - 1) * (size(collect_set({col})) - 1)").alias("dof"),
        )
        .selectExpr(*by, "CASE WHEN dof = 1 THEN _corrected WHEN dof > 1 THEN _plain END AS chi2", "dof")
        .selectExpr(*by, "chi2", "dof", f"{chi2_tail('chi2', 'dof')} AS p_value")
    )


def chi_square_position(
    facts: DataFrame,
    position: str = "position2",
    per_label: bool = False,
    by_group: str | None = None,
) -> DataFrame:
    """Chi-square tests of labels against position classes.

    Plain: position x label over the labels members hold. ``per_label``: held or not x
    position, one test per label. ``by_group`` repeats either for each group of an array.
    """
    # Members are counted by position and label sets, and only the counts are opened.
    groups = [by_group] if by_group else []
    sets = ["credit", "paper_credit"]
    rows = participation(tally(facts, [position, *groups, *sets], name="_w"), [position, *groups, "_w"], *sets)
    if per_label:
        cells = contingency(rows, "held", position, ["label"], by_group, "_w")
        return chi_square(cells, "held", position, [*groups, "label"])
    cells = contingency(rows.filter("held = 1"), position, "label", (), by_group, "_w")
    return chi_square(cells, position, "label", groups)
