"""Alignment of two tokenizers against the libraries on whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bylines.llm import cross_tokenizer as X
from bylines.llm.queries import vocabulary
from bylines.llm.token_counts import byte_symbols

from llm_support import AWKWARD

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "a", "foo  bar", " x", "x ", "a\nb \n  c", "é\x00b", "<s> a <0x0A> b", "▁ab", "a ▁",
    "ﬁ  ２", "<|endoftext|> x", "a\tb  ", "中 文中文 \U0001f600x", "z" * 5000, " " * 300, "a　 b\x1c c\x85 d",
    "x ▁ y", "it's we'll 'S  's", "\n", " \n ", "1 22 333  4444", "x\xa0 y", "unspelled ▁ " * 50 + "word",
]


def plainly(texts):
    """The query's columns of each text, from whole texts and a dictionary of counts."""
    exact, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    exact.encode_special_tokens = True
    byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
    found, total = [], Counter()
    for text in texts:
        own = exact.encode(f" {text or ''}", add_special_tokens=False)
        a = [bytes(map(byte_of.get, token)) for token in own.tokens]
        ids = pieces.encode(text or "")
        names = [pieces.id_to_piece(i) for i in ids]
        b = [
            bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode()
            for i, n in zip(ids, names, strict=True)
        ]
        if not text or not b"".join(a) == b"".join(b) == f" {text}".encode():
            found.append(None)
            continue
        ends_a, ends_b = (dict(zip(np.cumsum([len(t) for t in x]).tolist(), range(len(x)), strict=True)) for x in (a, b))
        ids_a, groups, links, i, j = own.ids, [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            to, until = ends_a[end] + 1, ends_b[end] + 1
            groups.append("|".join(",".join(map(str, part)) for part in (ids_a[i:to], ids[j:until])))
            links.append((ids_a[to - 1], ids[until - 1]))
            i, j = to, until
        total.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b_id), n in total.items():
        best[b_id] = max(n, best.get(b_id, 0))
    for row in found:
        if row is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            *sizes, links, digest = row
            top = sum(total[pair] == best[pair[1]] for pair in links)
            yield (*sizes, len(links), top, sum(total[pair] for pair in links), digest)


def columns(df):
    names = ["doc_id", *(c.split()[0] for c in X.SCHEMA.split(", "))]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_alignment_equals_whole_texts(spark, texts):
    rows = [*texts.items(), *((10**6 + i, t) for i, t in enumerate(ODD))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = [(i, *own) for (i, _), own in zip(rows, plainly([t for _, t in rows]), strict=True)]
    assert columns(X.align_tokenizers(df, A, B)) == sorted(want, key=str)


def test_long_texts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 100)
    monkeypatch.setattr(X, "TOGETHER", 300)
    words = X.Vocabularies(A, B)
    chunks = X.Chunks(words, known=40)
    texts = ["some words to align " * 30, "short", None, "▁ " + "unspelled " * 60, "more of the same words " * 40, ""]
    for _ in range(3):
        chunks.forget()
        got = {}
        for place, numbers in X.spelled_texts(words, chunks, texts):
            got[place] = got.get(place, "") + "".join(chunks.texts[i] for i in numbers)
            assert chunks.numbers[0][numbers].sum() > 0
        assert set(got) == {0, 1, 4}
        for place, groups in got.items():
            assert groups[:-1].count("|") == list(plainly([texts[place]]))[0][2]


def test_defined_results(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert len(rows) == len(AWKWARD)
    want = [(i, *own) for (i, _), own in zip(rows, plainly([t for _, t in rows]), strict=True)]
    assert columns(X.align_tokenizers(awkward, A, B)) == sorted(want, key=str)
    assert X.align_tokenizers(nothing, A, B).count() == 0


def test_bound_of_pairs():
    words = X.Vocabularies(A, B)
    assert words.most_pairs() == 324_297
    assert words.separable


@pytest.mark.parametrize("size", [0, 1, 5, 20_000])
def test_perfect_hash(size):
    rng = np.random.default_rng(size)
    keys = np.unique(rng.integers(0, 1 << 47, size))
    table = X.PerfectHash(keys)
    assert sorted(table.indices(keys).tolist()) == list(range(len(keys)))
    assert (table.keys[table.indices(keys)] == keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 47, 1000), keys)
    assert (table.indices(others) == -1).all()
