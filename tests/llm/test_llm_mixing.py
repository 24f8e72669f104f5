"""Source mixing against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from bylines.llm import mixing

from llm_support import AWKWARD

SCHEMA = "doc_id bigint, text string, source string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def levelled(sizes, weights=(3, 1, 2), share=Fraction(3, 2), epochs=2):
    """Targets by sharing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, Fraction(0)), share * sum(sizes.values()), set(names)
    while open_ and left:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = Fraction(0)
        for s in list(open_):
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = Fraction(epochs * sizes[s])
                open_.remove(s)
    return target


def check(df, rows, **options):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = levelled(sizes, **{k: v for k, v in options.items() if k in ("weights", "share", "epochs")})
    got = mixing.mix_sources(df, **options).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter(
        (i, len(words(t)), s) for i, t, s in rows
    )
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(target[r["source"]]), rel=1e-12)
        assert 0 <= r["taken"] <= options.get("epochs", 2) * r["size"]
        taken[r["source"]] += r["taken"]
    for source, n in target.items():
        assert abs(taken[source] - n) <= Fraction(1, 2)
    # Within a source the first rows by key are taken once more than the others.
    for source, n in target.items():
        own = sorted((r for r in got if r["source"] == source and r["size"]), key=lambda r: (r["key"], -r["taken"]))
        times = [Fraction(r["taken"], r["size"]) for r in own]
        assert times == sorted(times, reverse=True)
        assert sum(t.denominator > 1 for t in times) <= 1
    return got


def test_targets_and_cuts(spark):
    rng = random.Random(2)
    for sizes in ([5], [400, 3, 1], [1, 90, 7, 300, 0, 2], [1, 1, 1000]):
        rows = [
            (rng.randint(0, 10**6), " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 9))), f"s{k}")
            for k, n in enumerate(sizes)
            for _ in range(n)
        ]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = check(df, rows, digits=1)
        again = mixing.mix_sources(df.repartition(2), digits=1).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    check(df, rows, weights=(1, 5), share=Fraction(7, 3), epochs=3)
    check(df, rows, share=Fraction(2))


def test_repeats_of_one_row(spark):
    """A third of all rows the same, in more blocks than one, and ids that are missing or repeat."""
    rows = [(1, "a b  c\td", "hot")] * 9000 + [(None, "x y", None)] * 50 + [(i % 5, f"w{i} z", "b") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    check(df, rows)


def test_texts_of_the_mix(spark, documents):
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(documents).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = defaultdict(list)
    for r in mixing.mixed_texts(documents).collect():
        found[r["doc_id"]].append((r["epoch"], r["text"]))
    for i, taken in plan.items():
        own = [t for _, t in sorted(found[i])]
        assert sum(len(words(t)) for t in own) == taken
        assert all(t == texts[i] for t in own[:-1])
        assert all(texts[i].startswith(t) for t in own)


def test_word_count(spark):
    cases = ["", " ", "a", " a ", "a b", "\n\na\x0bb\tc\x0cd\r", "é\xa0中 \U0001f600", "x " * 5000, "\x00 \x1c", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string")
    got = {r["i"]: r["n"] for r in df.select("i", mixing.word_count(df["text"]).alias("n")).collect()}
    assert got == {i: len(words(t)) for i, t in enumerate(cases)}


def test_defined_results(awkward, nothing):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    assert len(rows) == len(AWKWARD)
    check(awkward, rows)
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mixed_texts(nothing).count() == 0
    blank = awkward.filter("doc_id IN (2, 3, 4)")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(blank).collect()} == {(0, 0.0, 0)}
    assert mixing.mixed_texts(blank).count() == 0
