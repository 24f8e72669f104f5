from __future__ import annotations

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest

from bylines.functions.chi2 import chi2_tail
from bylines.operators.independence import chi_square, contingency, with_expected


def upper_gamma(dof: int, x: float) -> float:
    """The tail by the textbook recurrence Q(a + 1, h) = Q(a, h) + h^a e^-h / gamma(a + 1)."""
    h = x / 2
    a, q = (1.0, math.exp(-h)) if dof % 2 == 0 else (0.5, math.erfc(math.sqrt(h)))
    while a < dof / 2:
        q += math.exp(a * math.log(h) - h - math.lgamma(a + 1))
        a += 1
    return q


def test_tail(spark):
    statistics = [1e-3, 0.5, 3.84, 7.9, 8.1, 30.0, 120.0, 600.0]
    points = [(x, d) for d in [1, 2, 3, 4, 5, 13, 26, 27, 101] for x in statistics]
    df = spark.createDataFrame(points, "x double, d int").selectExpr("x", "d", f"{chi2_tail('x', 'd')} AS p")
    for r in df.collect():
        assert r["p"] == pytest.approx(upper_gamma(r["d"], r["x"]), rel=1e-9, abs=1e-300)


def test_tail_edges(spark):
    df = spark.createDataFrame([(0.0, 3), (1e9, 26), (None, 2), (1.0, 0), (1.0, None)], "x double, d int")
    got = [r["p"] for r in df.selectExpr(f"{chi2_tail('x', 'd')} AS p").collect()]
    assert got == [1.0, 0.0, None, None, None]


def cells(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, line in enumerate(table) for j, n in enumerate(line) for _ in range(n)]
    return spark.createDataFrame(rows, "r string, c string")


def test_agrees_with_spark_ml(spark):
    df = cells(spark, [[5, 0, 7, 2], [3, 9, 1, 4], [6, 6, 6, 1]])
    (got,) = chi_square(contingency(df, "r", "c"), "r", "c").collect()
    coded = df.selectExpr("CAST(substr(r, 2) AS DOUBLE) AS label", "CAST(substr(c, 2) AS DOUBLE) AS f").collect()
    vectors = spark.createDataFrame([(r["label"], Vectors.dense([r["f"]])) for r in coded], ["label", "features"])
    want = ChiSquareTest.test(vectors, "features", "label").head()
    assert got["chi2"] == pytest.approx(want["statistics"][0])
    assert got["dof"] == want["degreesOfFreedom"][0] == 6
    assert got["p_value"] == pytest.approx(want["pValues"][0])


def test_yates_at_one_degree(spark):
    table = contingency(cells(spark, [[10, 20], [30, 15]]), "r", "c")
    (plain,) = chi_square(table, "r", "c", yates=False).collect()
    (corrected,) = chi_square(table, "r", "c").collect()
    assert plain["chi2"] == pytest.approx(75 * (10 * 15 - 20 * 30) ** 2 / (30 * 45 * 40 * 35))
    assert corrected["chi2"] == pytest.approx(75 * (abs(10 * 15 - 20 * 30) - 37.5) ** 2 / (30 * 45 * 40 * 35))
    assert corrected["p_value"] == pytest.approx(math.erfc(math.sqrt(corrected["chi2"] / 2)))


def test_one_indicator_value_has_no_test(spark):
    (got,) = chi_square(contingency(cells(spark, [[5, 3, 2]]), "r", "c"), "r", "c").collect()
    assert (got["chi2"], got["dof"], got["p_value"]) == (None, 0, None)


def test_expected_margins_equal_observed(spark):
    rows = with_expected(contingency(cells(spark, [[5, 0, 7], [3, 9, 0]]), "r", "c"), "r", "c").collect()
    assert len(rows) == 6
    for key in ("r", "c"):
        for value in {x[key] for x in rows}:
            part = [x for x in rows if x[key] == value]
            assert sum(x["n"] for x in part) == pytest.approx(sum(x["expected"] for x in part))
