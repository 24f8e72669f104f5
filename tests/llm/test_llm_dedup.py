"""Exact, near and substring duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bylines.llm import exact_dedup, simhash, substring_dedup
from bylines.llm.common import attach
from bylines.llm.components import components

from llm_support import AWKWARD, prose


def groups_by_text(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    of = {}
    for (i, _), n in zip(rows, norm, strict=True):
        of.setdefault(n, []).append(i)
    found = []
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [x for x in of[n] if x is not None]
        keep = min(ids) if ids else None
        found.append((i, keep, len(of[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return found


def result(df):
    rows = df.withColumn("hex", F.lower(F.hex("digest"))).collect()
    return [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["hex"]) for r in rows]


@pytest.mark.parametrize("salts", [1, 64])
def test_exact_groups_equal_brute_force(awkward, salts):
    got = result(exact_dedup.exact_groups(awkward, salts=salts))
    assert sorted(got, key=str) == sorted(groups_by_text(AWKWARD), key=str)


def test_texts_that_share_a_digest_stay_apart(spark):
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "c d"), (5, "c  d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = exact_dedup.exact_groups(df, digest=lambda text: F.lit(b"same"))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found.collect()} == {
        1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 2), 5: (4, 2),
    }


def test_no_python_in_exact_groups(spark, documents):
    plan = exact_dedup.exact_groups(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_keep_first_keeps_all_columns(awkward):
    kept = exact_dedup.keep_first(awkward)
    assert kept.columns == awkward.columns
    want = Counter({(i, t) for (i, t), g in zip(AWKWARD, groups_by_text(AWKWARD), strict=True) if g[3]})  # one row each
    assert Counter((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()) == want


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def near_classes(prints):
    """Component of every fingerprint by comparing all pairs."""
    values = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ value) <= 2).tolist():
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {int(v): root(i) for i, v in enumerate(values)}


def test_near_duplicates_equal_brute_force(awkward):
    rows = [(i, fingerprint(t) if len(t or "") < 300_000 else None) for i, t in AWKWARD]
    got = {}
    for r in simhash.near_duplicates(awkward).collect():
        got.setdefault(r["doc_id"], []).append((r["fingerprint"] % 2**64, r["component_id"]))
    assert sum(map(len, got.values())) == len(AWKWARD)
    classes = near_classes([f for _, f in rows if f is not None])
    least = {}
    for i, f in rows:
        if i is not None and f is not None:
            least[classes[f]] = min(i, least.get(classes[f], i))
    for i, f in rows:
        if f is not None:
            assert (f, least.get(classes[f])) in got[i]


@pytest.mark.parametrize("crowd", [1, 8, 10**6])
def test_links_join_what_is_near(spark, crowd):
    """Families of near fingerprints, one with hundreds that share a segment, whatever counts as crowded."""
    rng = random.Random(crowd)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(40):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(value)
            for _ in range(rng.randint(1, 3)):
                value ^= 1 << rng.randrange(64)
    high = rng.getrandbits(32) << 32
    prints |= {high | rng.getrandbits(12) << rng.randrange(20) for _ in range(400)}
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in sorted(prints)], "fingerprint bigint")
    found = simhash.links(df, crowd)
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    classes = near_classes(prints)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(found).collect()}
    own = {p: roots.get(p, p) for p in prints}
    assert len(set(own.values())) == len(set(classes.values()))
    assert len({(own[p], classes[p]) for p in prints}) == len(set(classes.values()))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    rng.shuffle(chain)
    df = spark.createDataFrame([*chain, *star, (7, 7)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in components(df).collect()} == {
        **dict.fromkeys(range(1, 201), 0),
        **dict.fromkeys(range(1001, 1300), 1000),
    }
    assert components(df.filter("a < 0")).count() == 0


def removed(rows, window=20):
    """(id, words, words removed, digest of the rest) for rows with distinct ids, window by window."""
    seen, found = set(), []
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            own = tuple(words[s : s + window])
            gone |= set(range(s, s + window)) if own in seen else set()
            seen.add(own)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        found.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return found


def trimmed(df):
    rows = df.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=str)


def test_removed_words_equal_brute_force(documents, texts):
    assert trimmed(substring_dedup.remove_repeats(documents)) == sorted(removed(texts.items()), key=str)


def test_passages_at_every_offset(spark):
    """Passages of 19 to 60 words at shifting places, repeats inside one text, and few distinct words."""
    rng = random.Random(5)
    shared = [prose(100 + k, n) for k, n in enumerate((19, 20, 21, 33, 60))]
    rows = []
    for i in range(60):
        parts = [prose(1000 + i, rng.randint(0, 30)), rng.choice(shared), prose(2000 + i, rng.randint(0, 30))]
        rows.append((i, " ".join([*parts, rng.choice(shared)])))
    rows += [(60 + i, " ".join(rng.choice("ab") for _ in range(120))) for i in range(5)]
    rows += [(70, "same " * 90), (71, "same " * 25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert trimmed(substring_dedup.remove_repeats(df)) == sorted(removed(rows), key=str)
    df = df.coalesce(1)
    assert trimmed(substring_dedup.remove_repeats(df)) == sorted(removed(rows), key=str)


def test_awkward_rows(awkward):
    got = trimmed(substring_dedup.remove_repeats(awkward))
    assert len(got) == len(AWKWARD)
    by = {}
    for i, n, gone, _ in got:
        by.setdefault(i, []).append((n, gone))
    assert by[1] == [(80, 0)]
    assert by[5] == [(50, 0), (50, 0)]  # a row that repeats is the same document
    assert by[6] == [(50, 0), (50, 0)]
    assert by[9] == [(82, 80)]
    assert sorted(by[None]) == [(0, 0), (80, 80)]  # rows without id come last
    assert by[7] == [(60_000, 0)]


def test_cover_is_checked(documents):
    assert substring_dedup.is_cover(substring_dedup.COVER, substring_dedup.PERIOD)
    with pytest.raises(ValueError, match="cover"):
        substring_dedup.remove_repeats(documents, cover=(0, 1))


def test_empty_tables(nothing):
    for frame in (
        exact_dedup.exact_groups(nothing),
        exact_dedup.keep_first(nothing),
        simhash.near_duplicates(nothing),
        simhash.keep_one(nothing),
        substring_dedup.remove_repeats(nothing),
    ):
        assert frame.count() == 0


def kept_texts(df):
    return sorted((str(r["doc_id"]), r["text"]) for r in df.collect())


def test_one_row_stays_whatever_the_ids(spark):
    """Several components and texts without any id, near copies of rows with one, and ids that repeat."""
    one, two, three = prose(40, 60), prose(41, 60), prose(42, 60)
    near = one.rsplit(" ", 1)[0]
    assert (fingerprint(one) ^ fingerprint(near)).bit_count() <= 2
    rows = [(None, near), (None, near), (7, one), (7, one), (9, one), (None, two), (None, two), (None, three), (8, near)]
    rows += [(7, prose(43, 60))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, _id string, _digest string")
    df = df.repartition(3)
    want = [(7, one), (7, rows[-1][1]), (None, two), (None, three)]
    assert kept_texts(simhash.keep_one(df)) == sorted((str(i), t) for i, t in want)
    assert simhash.keep_one(df).columns == exact_dedup.keep_first(df).columns == df.columns
    assert kept_texts(exact_dedup.keep_first(df)) == sorted((str(i), t) for i, t in [*want, (8, near)])


def test_a_row_repeated_for_a_third_of_the_table(spark):
    rows = [(1, prose(50, 30))] * 9000 + [(None, prose(51, 30))] * 9000 + [(i, prose(60 + i % 40, 30)) for i in range(2, 9002)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert len(kept_texts(exact_dedup.keep_first(df))) == len(kept_texts(simhash.keep_one(df))) == 42
    for found in (exact_dedup.exact_groups(df), simhash.near_duplicates(df)):
        assert Counter(r["doc_id"] for r in found.collect()) == Counter(i for i, _ in rows)


def test_attached_values_are_never_broadcast(spark):
    """Spark takes the rows behind an explode for as many as in front of it, so small tables may hide large ones."""
    prints = spark.range(500).withColumnRenamed("id", "fingerprint")
    rows = prints.selectExpr("fingerprint", "explode(sequence(fingerprint, fingerprint + 33)) AS value")
    sizes = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    attached = attach(rows, sizes, "value", "fingerprint")
    want = Counter(v for f in range(500) for v in range(f, f + 34))
    assert all(r["size"] == want[r["value"]] for r in attached.collect())
    assert attached.count() == 500 * 34
    plan = attached._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
