from __future__ import annotations

import random

import pytest

from bylines.functions import groups as G
from bylines.functions import labels as L
from bylines.operators.facts import build_facts, label_counts, member_facts, with_position_class


def by_auid(df):
    return {r["auid"]: r for r in df.collect()}


def test_empty_and_null_credit(curated_rows):
    """'' makes a member without allowed labels, NULL makes none; both only show in row_count."""
    df = curated_rows(
        ("a", 2020, ["MEDI"], 1, 1, "Software, Formal Analysis"),
        ("a", 2020, ["MEDI"], 2, 2, ""),
        ("a", 2020, ["MEDI"], 3, 3, None),
        ("a", 2020, ["MEDI"], 4, 9, "Cooking"),
    )
    facts = by_auid(build_facts(df))
    assert set(facts) == {1}
    assert facts[1]["credit"] == ["Formal analysis", "Software"]
    assert facts[1]["row_count"] == 3
    assert (facts[1]["position_min"], facts[1]["position_max"]) == (1, 9)
    assert set(by_auid(build_facts(df, keep_empty=True))) == {1, 2, 4}


def test_member_facts_are_part_of_facts(curated_rows):
    df = curated_rows(
        ("a", 2020, ["MEDI"], 1, 1, "Software"), ("a", 2020, ["MEDI"], 2, 2, ""), (None, None, None, 3, 1, "Software")
    )
    part = member_facts(df)
    assert plan_shuffles(part) == 1
    whole = build_facts(df).select(*part.columns)
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))


def plan_shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_split_rows_of_a_member_are_merged(curated_rows):
    df = curated_rows(
        ("a", 2020, [], 1, 1, "Software"),
        ("a", 2020, [], 1, 1, "Software, Resources, Software"),
    )
    (row,) = build_facts(df).collect()
    assert (row["credit"], row["au_credit_num"], row["row_count"]) == (["Resources", "Software"], 2, 1)
    counts = {r["label"]: r["n"] for r in label_counts(df).collect()}
    assert counts == {"Software": 3, "Resources": 1}


def test_null_entity_and_period(curated_rows):
    df = curated_rows(
        (None, 2020, [], 1, 1, "Software"),
        (None, 2020, [], 2, 2, "Software"),
        ("a", None, [], 3, 4, "Software"),
        ("a", 2021, [], 4, 7, "Resources"),
    )
    facts = by_auid(build_facts(df))
    assert (facts[1]["row_count"], facts[1]["position_max"], facts[1]["paper_credit"]) == (0, None, None)
    assert (facts[3]["row_count"], facts[3]["position_min"], facts[3]["position_max"]) == (2, 4, 7)
    assert (facts[3]["paper_credit"], facts[3]["paper_credit_num"]) == (None, None)
    assert facts[4]["paper_credit"] == ["Resources"]


def test_two_sources_keep_two_surnames(curated_rows, spark):
    df = curated_rows(("a", 2020, [], 1, 1, "Software"))
    both = df.unionByName(df.selectExpr("* EXCEPT (surname)", "upper(surname) AS surname"))
    assert {r["row_count"] for r in build_facts(both).collect()} == {2}


def test_position_class(curated_rows):
    df = curated_rows(
        ("sole", 2020, [], 1, 5, "Software"),
        ("tied", 2020, [], 2, 1, "Software"),
        ("tied", 2020, [], 3, 1, "Software"),
        ("tied", 2020, [], 4, 2, "Software"),
        ("tied", 2020, [], 5, 10, "Software"),
        ("tied", 2020, [], 6, None, "Software"),
    )
    classes = {a: r["position2"] for a, r in by_auid(with_position_class(build_facts(df))).items()}
    assert classes == {
        1: "First author",
        2: "First author",
        3: "First author",
        4: "Middle author",
        5: "Last author",
        6: "Middle author",
    }


def test_unknown_code(spark):
    df = spark.createDataFrame(
        [(["ZZZZ"],), (["MULT", "MEDI", "MEDI", "ZZZZ"],), ([None, "PHYS"],), ([],), (None,)], "codes array<string>"
    )
    rows = df.selectExpr(
        f"{G.groups_of('codes')} AS listed",
        f"transform(codes, x -> {G.group_of('x')}) AS each",
        f"{G.default_groups_of('codes')} AS folded",
    ).collect()
    assert [r["listed"] for r in rows] == [[], ["Health Sciences", "Multidisciplinary"], ["Physical Sciences"], [], []]
    assert rows[0]["each"] == ["multidisciplinary"]
    assert rows[2]["each"] == ["multidisciplinary", "physical_sciences"]
    assert rows[1]["folded"] == ["multidisciplinary", "health_sciences"]


@pytest.mark.parametrize("size", [3, 63, 64, 130])
def test_masks_hold_any_vocabulary(spark, size):
    vocab = [f"l'{i}\\" for i in range(size)]
    aliases = {"first": vocab[0], "last": vocab[-1], vocab[1]: vocab[2]}
    text = ", ".join(["first", vocab[1], "none", "last", vocab[0]])
    df = spark.createDataFrame([(text,), ("",)], "credit string")
    masks = L.label_masks("credit", vocab, aliases)
    names = [f"m{i}" for i in range(len(masks))]
    held = df.selectExpr(*[f"{m} AS {n}" for m, n in zip(masks, names, strict=True)]).selectExpr(
        f"{L.labels_of_masks(names, vocab)} AS held", f"{L.mask_count(names)} AS n", f"{L.any_label(names)} AS some"
    )
    want = [v for i, v in enumerate(vocab) if i in {0, 2, size - 1}]
    assert [tuple(r) for r in held.collect()] == [(want, len(want), True), ([], 0, False)]


def test_masks_equal_splitting(spark):
    """Fenced search against split and compare, on text full of near separators."""
    vocab = ["a", "b", "ab", "a b", ",a", "a,", " a", "a ", "", "a, b"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", ",", " ", ", "]) for _ in range(rng.randrange(9))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    (mask,) = L.label_masks("t", vocab, {})
    rows = df.selectExpr("t", f"{mask} AS m").selectExpr("t", f"{L.labels_of_masks(['m'], vocab)} AS held").collect()
    for r in rows:
        assert r["held"] == [v for v in vocab if v in r["t"].split(", ")]


def test_separator_that_overlaps_itself_is_refused():
    with pytest.raises(ValueError):
        L.label_masks("t", ["a"], {}, "; ;")
