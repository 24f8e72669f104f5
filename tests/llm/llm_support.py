"""Rows and helpers that the tests of the text operators share."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"

# Names that operators use for their own results or helpers.
CLASHING = (
    "score", "kept", "digest", "row", "place", "hash", "fingerprint", "component_id", "spans", "items", "n_words",
    "n_tokens", "group_size", "keep_id", "matches", "_share", "_salt", "_text", "_key", "value", "order", "bucket",
    "_id", "_digest", "_hash", "_copies", "copies", "root", "_root", "_spread", "_block", "taken", "size", "source_size",
)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
    f"`{c}` string" for c in CLASHING
)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(words))


LONG = prose(1, 60_000)
AWKWARD = [
    (1, prose(2, 80)),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (None, prose(2, 80)),
    (None, None),
    (5, prose(3, 50)),
    (5, prose(3, 50)),
    (6, prose(4, 50)),
    (6, prose(5, 50)),
    (7, LONG),
    (8, "x" * 100_000),
    (9, prose(2, 80) + " and more"),
    (10, "one"),
    (11, "é ß 中文 \U0001f600 \x00 !!! 123"),
]
