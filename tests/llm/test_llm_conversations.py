"""Repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from bylines.llm import conversations as C
from bylines.llm.queries import QUERIES

from llm_support import SF

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(turns):
    """Least cost and audit by Dijkstra over turns and places; a turn is initial, gone, truncated."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, place = heapq.heappop(heap)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == len(turns) and place in (0, 3):
            return cost, audit
        if i < len(turns):
            initial, gone, more = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, place))
            for letter, to in NEXT[place].items() if not gone else ():
                if initial == letter:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
                if letter != "s":
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to))
        for letter, to in NEXT[place].items():
            if letter != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, to))


def repaired(rows, ids):
    """All columns of the query by conversation, turn by turn."""
    by = {i: [] for i in ids}
    for c, *turn in rows:
        by.setdefault(c, []).append([turn[0], *(" " if v is None else v for v in turn[1:])])
    found = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, turns, faults = set(), [], []
        for _, role, text in own:
            letters = re.findall("[^\x20\x09-\x0d]", text)
            if not letters:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
            turns.append((role[:1], faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = cheapest(turns)
        lines, at, size = [], 0, len(audit.replace("D", ""))
        for edit in audit:
            role = own[at][1] if edit == "K" else ("user", "assistant")[(len(lines) + size) % 2]
            if edit != "D":
                lines.append(f"{role}:{'' if edit == 'I' else own[at][2]}")
            at += edit != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = (faults.count(f) for f in ("blank", "duplicate", "truncated"))
        found[c] = (gaps, *counts, illegal, cost, audit, digest)
    return found


def shown(faults, turns):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = C.stacked([faults, C.digests(turns)], names).collect()
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: (*tuple(r)[1:8], r["repaired_sha256"] or empty) for r in rows}


@pytest.mark.parametrize("block", [3, 16])
def test_least_audits(block):
    rng = random.Random(4)
    for _ in range(400):
        turns = "".join(rng.choice("suaosuaSUAO-ua") for _ in range(rng.randint(0, 20)))
        found = C.matrix(turns, (C.START,), block)
        parts = [(t.lower(), t == "-", t.isupper()) for t in turns]
        assert min(found[C.START, end] for end in C.ENDS if (C.START, end) in found) == cheapest(parts), turns


def test_targets():
    for start in range(4):
        for end in range(4):
            for length in range(6):
                ways, places = [], {("", start)}
                for _ in range(length):
                    places = {(t + c, to) for t, p in places for c, to in NEXT[p].items()}
                ways = [t for t, p in places if p == end]
                assert [C.target(start, end, length)] == (ways or [None])


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        hurt += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert got == repaired(hurt, {r[0] for r in rows})


AWKWARD = [
    (1, None, "user", "First?"),
    (1, 0, None, "No role."),
    (1, 0, "assistant", None),
    (1, 2, "", "empty role."),
    (None, 1, "user", "Lost."),
    (None, 5, "assistant", "Found!  "),
    (None, None, None, None),
    (2, 1, "system", "S."),
    (2, 1, "system", "S."),
    (2, 1, "user", "tie."),
    (2, 1, "assistant", "tie."),
    (3, 7, "tool", "\t \x0b"),
    (4, 1, "user", "é中\U0001f600"),
    (4, 2, "assistant", "word " * 50_000 + "."),
    (5, -3, "user", "."),
    (5, 9, "assistant", "x\n"),
]
NAMES = "part at place copies digest text2 _share _row first again".split()


def test_defined_results(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    df = spark.createDataFrame([(*r, *NAMES) for r in AWKWARD], schema).repartition(3)
    faults, turns = C.repair(df)
    assert shown(faults, turns) == repaired(AWKWARD, ())
    assert turns.columns == ["conv_id", "place", "turn", "role", "text", "edit"]
    assert C.damaged(df).columns == ["conv_id", "turn", "role", "text"]
    faults, turns = C.repair(df.limit(0))
    assert faults.count() == turns.count() == 0


def test_one_conversation_over_many_ranges(spark):
    """Two thirds of all rows in one conversation, a third of them repeats of one row."""
    rng = random.Random(9)
    rows = [(7, t, rng.choice(("user", "assistant", "system")), f"turn {t}{rng.choice('.?,')}") for t in range(700)]
    rows += [(7, 350, "user", "again.")] * 700 + [(i, 0, "user", "Hi.") for i in range(100, 500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    assert shown(*C.repair(df)) == repaired(rows, ())
