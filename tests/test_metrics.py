from __future__ import annotations

from itertools import combinations

import pytest

from bylines.functions.bins import bin_of
from bylines.operators import metrics as M
from bylines.operators.cooccurrence import cooccurrence
from bylines.operators.facts import build_facts, with_position_class

VOCAB = ("Software", "Resources", "Supervision", "Validation")


@pytest.fixture
def facts(curated_rows):
    credits = ["Software", "Software, Resources", "Resources, Supervision, Software", "Supervision", "", "Software"]
    areas = [["MEDI"], ["MEDI", "PHYS"], ["ZZZZ"], [], ["PHYS", "MULT", "MATH"]]
    rows = [
        (f"d{i % 9}", 2020, areas[i % 9 % 5], i, i // 9, credits[i % 7 % 6])
        for i in range(60)
    ]
    return with_position_class(build_facts(curated_rows(*rows)))


def test_cooccurrence_equals_two_filters(facts):
    rows = facts.collect()
    pairs = cooccurrence(facts, vocab=VOCAB).collect()
    got = {(r["element1"], r["element2"]): (r["either"], r["both"], r["ratio"]) for r in pairs}
    assert list(got) == list(combinations(VOCAB, 2))
    for (a, b), (either, both, ratio) in got.items():
        assert both == sum(a in r["credit"] and b in r["credit"] for r in rows)
        assert either == sum(a in r["credit"] or b in r["credit"] for r in rows)
        assert ratio == (both / either if either else None)
        assert either >= both


def test_cooccurrence_by_group(facts):
    rows = facts.collect()
    got = cooccurrence(facts, vocab=VOCAB, by="discipline").collect()
    assert len(got) == 5 * 6
    for r in got:
        members = [f["credit"] for f in rows if r["discipline"] in f["discipline"]]
        assert r["both"] == sum({r["element1"], r["element2"]} <= set(c) for c in members)
        assert r["either"] == sum(bool({r["element1"], r["element2"]} & set(c)) for c in members)


def test_cooccurrence_of_absent_pair_and_no_rows(facts):
    empty = cooccurrence(facts.filter("FALSE"), vocab=VOCAB).collect()
    assert [(r["either"], r["both"], r["ratio"]) for r in empty] == [(0, 0, None)] * 6


def test_shares_bins_and_positions_add_up(facts):
    bins = M.bin_share(M.to_entities(facts)).groupBy("discipline").sum("share").collect()
    assert bins and all(r[1] == pytest.approx(1) for r in bins)
    assert sum(r["n"] for r in M.count_by_position(facts).collect()) == facts.count()
    rates = M.label_rate(facts).collect()
    rows = facts.collect()
    for r in rates:
        of_class = [f for f in rows if f["position2"] == r["position2"]]
        assert r["n"] == sum(r["label"] in f["credit"] for f in of_class)
        assert r["rate"] == pytest.approx(r["n"] / len(of_class))


def test_share_of_entity_with_two_category_lists(curated_rows):
    df = curated_rows(
        ("a", 2020, ["MEDI"], 1, 1, "Software"),
        ("a", 2020, ["PHYS"], 2, 2, "Resources"),
        ("a", 2020, ["PHYS"], 3, 3, ""),
        (None, 2020, ["PHYS"], 4, 1, "Software"),
    )
    rows = M.label_share(build_facts(df)).collect()
    got = {(r["subjareas"][0], r["label"]): (r["n"], round(r["share"], 9)) for r in rows}
    assert set(got) == {(s, label) for s in ("MEDI", "PHYS") for label in ("Software", "Resources")}
    assert set(got.values()) == {(1, round(1 / 3, 9))}


def test_entity_mean_spans_its_rows(curated_rows):
    df = curated_rows(
        ("a", 2020, ["MEDI"], 1, 1, "Software"),
        ("a", 2021, ["PHYS"], 2, 2, "Resources, Software"),
        (None, 2021, ["PHYS"], 3, 2, "Resources, Software"),
    )
    rows = M.to_entities(build_facts(df)).collect()
    got = {(r["doi"], r["year"]): (r["members"], r["paper_au_credit_avg"]) for r in rows}
    assert got == {("a", 2020): (1, 1.5), ("a", 2021): (1, 1.5), (None, 2021): (1, None)}


def test_bins_are_half_open(spark):
    values = [None, 0.5, 1.0, 1.99, 2.0, 7.5, 8.0, 14.0, 20.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").selectExpr(f"{bin_of('v')} AS b")
    want = [None, None, "[1,2)", "[1,2)", "[2,3)", "[7,8)", "[8,14]", "[8,14]", "[8,14]"]
    assert [r["b"] for r in df.collect()] == want


def test_zero_fill(facts):
    share = M.label_share(facts).cache()
    rows = share.collect()
    for r in M.mean_share(share, zero_fill=True).collect():
        of_code = [s for s in rows if r["subjareas"] in s["subjareas"]]
        entities = {s["doi"] for s in of_code}
        total = sum(s["share"] for s in of_code if s["label"] == r["label"])
        assert r["mean_share"] == pytest.approx(total / len(entities))
    share.unpersist()
