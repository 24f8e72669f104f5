"""Repair of conversations by the cheapest edits, with an audit of them.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: perhaps a system turn, then
user and assistant in turn. Turns may be kept, given another role or deleted, and empty ones
inserted. There is one such string of each length but 1. Turns are aligned with each by the dynamic
programme of Wagner and Fischer. As a cell off the diagonal costs insertions or deletions on the way
to it and back to the end, only a band of cells can lead to a cost as small as the best one so far
(Ukkonen); lengths whose shortest band is too dear are not tried. Of the cheapest edits the audit that
is least by ASCII is taken, found by tracing back each length and comparing.

A conversation may hold any part of all rows, so rows are sorted into ranges, which may begin and end
inside one. Stretches of ``BLOCK`` turns are aligned with the targets between each two places of the
grammar (before the first turn, behind s, u and a), and stretches are put together by places: the sum
of costs, and audits end to end. This is exact, since an audit of a stretch is never the beginning of
another one of equal cost that leads between the same places: the rest would be insertions, which
cost. Texts stay out of all this: turns travel with a digest of their text, and only those that are
kept meet their text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import attach, checkpointed, per_worker

BLOCK = 16  # turns that are aligned at once
SEEN = 200_000  # alignments that a task remembers
WHOLE = 64  # turns up to which a stretch is aligned only from the places where it turns out to begin
EXPANDED = 1 << 16  # edits that are listed at a time
NEVER = 1 << 60

# Costs, by the audit's initials, and what a truncated turn costs that stays.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1

SPACES = r"\x20\x09-\x0D"
START, SYSTEM, USER, ASSISTANT = range(4)  # places in the grammar, by what was read last
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}


Way = tuple[int, str]  # cost and audit
Matrix = dict[tuple[int, int], Way]  # by the places at which a stretch begins and ends


def target(start: int, end: int, length: int) -> str | None:
    """What leads from one place of the grammar to another in so many turns; None if nothing does."""
    text = ("ua" if start != USER else "au") * (length // 2 + 1)
    text = text[:length]
    reached = {"": start, "u": USER, "a": ASSISTANT}[text[-1:]]
    if start == START and length and reached != end:
        text = "s" + text[: length - 1]
        reached = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[text[-1]]
    return text if reached == end else None


def step_costs(turn: str, wanted: str) -> tuple[int, int]:
    """Costs of giving a turn the role, by keeping and by changing it; NEVER if that can't be."""
    more = TRUNCATED * turn.isupper()
    keep = more if turn.lower() == wanted else NEVER
    return keep, COSTS["R"] + more if turn != "-" and wanted != "s" else NEVER


def bound(ahead: int) -> int:
    """Least cost of being so many places of the target ahead of the turns, or behind if negative."""
    return COSTS["I"] * ahead if ahead > 0 else -COSTS["D"] * ahead


def align(turns: str, wanted: str, most: int) -> Way | None:
    """Least cost and least audit that make the turns the target; None if it costs more than ``most``.

    A turn is the initial of its role, s, u, a or o for others, upper case if it is truncated, or -
    if it has to go.
    """
    rows, columns = len(turns), len(wanted)
    last = columns - rows
    # Costs to the end, by turns and target places read; cells outside the band are absent.
    rest: list[dict[int, int]] = [{} for _ in range(rows + 1)]
    for i in range(rows, -1, -1):
        here, below = rest[i], rest[i + 1] if i < rows else {}
        low = max(0, i - most // COSTS["D"])
        for j in range(min(columns, i + most // COSTS["I"]), low - 1, -1):
            ahead = bound(j - i)
            if ahead + bound(last - (j - i)) > most:
                continue
            best = 0 if i == rows and j == columns else NEVER
            if j < columns:
                best = min(best, here.get(j + 1, NEVER) + COSTS["I"])
            if i < rows:
                best = min(best, below.get(j, NEVER) + COSTS["D"])
                if j < columns:
                    best = min(best, below.get(j + 1, NEVER) + min(step_costs(turns[i], wanted[j])))
            if ahead + best <= most:
                here[j] = best
    if 0 not in rest[0]:
        return None
    audit, i, j = [], 0, 0
    while i < rows or j < columns:
        cost = rest[i][j]
        keep, change = step_costs(turns[i], wanted[j]) if i < rows and j < columns else (NEVER, NEVER)
        for edit, price, di, dj in (("D", COSTS["D"], 1, 0), ("I", COSTS["I"], 0, 1), ("K", keep, 1, 1), ("R", change, 1, 1)):
            if i + di <= rows and j + dj <= columns and rest[i + di].get(j + dj, NEVER) + price == cost:
                audit.append(edit)
                i, j = i + di, j + dj
                break
    return rest[0][0], "".join(audit)


def between(turns: str, start: int, end: int) -> Way | None:
    """Cheapest and then least audit of a stretch of turns from one place of the grammar to another."""
    stay = len(turns) - turns.count("-")
    forced = COSTS["D"] * turns.count("-")
    best, most = None, NEVER
    # Nearest lengths first, so that the band is narrow from the beginning.
    length, farther = stay, 0
    while True:
        lengths = {stay + farther, stay - farther}
        near = [n for n in lengths if n >= 0]
        if all(forced + bound(n - stay) > most for n in near) or not near:
            break
        for length in near:
            wanted = target(start, end, length)
            if wanted is None:
                continue
            limit = most if best else forced + COSTS["D"] * stay + COSTS["I"] * length
            found = align(turns, wanted, limit)
            if found and (best is None or found < best):
                best, most = found, found[0]
        farther += 1
        if best is None and farther > len(turns) + 3:
            break
    return best


def joined(left: Matrix, right: Matrix) -> Matrix:
    """What leads through two stretches, one behind the other."""
    found: Matrix = {}
    for (start, middle), (cost, audit) in left.items():
        for end in range(4):
            if (middle, end) in right:
                more, behind = right[middle, end]
                own = cost + more, audit + behind
                if (start, end) not in found or own < found[start, end]:
                    found[start, end] = own
    return found


def remembered(turns: str, start: int, end: int) -> Way | None:
    """``between``, made once per Python worker for the same arguments."""
    memory: dict[tuple, Way | None] = per_worker(("alignments", None), dict)
    if len(memory) > SEEN:
        memory.clear()
    if (turns, start, end) not in memory:
        memory[turns, start, end] = between(turns, start, end)
    return memory[turns, start, end]


def matrix(turns: str, starts: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT), block: int = BLOCK) -> Matrix:
    """What leads through a stretch of turns, put together from blocks in a tree."""
    if len(turns) > block:
        half = (len(turns) // 2 + block - 1) // block * block
        left = matrix(turns[:half], starts, block)
        return joined(left, matrix(turns[half:], tuple(sorted({end for _, end in left})), block))
    pairs = ((s, e) for s in starts for e in range(4))
    return {(s, e): found for s, e in pairs if (found := remembered(turns, s, e))}


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32 of ``conv_id:turn``, modulo 20; NULLs become one space.

    0 drops the turn, 1 empties its text, 2 removes full stops, question and exclamation marks, 3
    repeats it, and 4 makes its role user.
    """
    spelled = [f"coalesce(CAST({c} AS string), ' ')" for c in ("conv_id", "turn")]
    fault = f"crc32(CAST(concat({spelled[0]}, ':', {spelled[1]}) AS binary)) % 20"
    text = "CASE _fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(_text, '[.!?]', '') ELSE _text END AS text"
    return (
        conversations.selectExpr(
            "conv_id", "turn", "coalesce(role, ' ') AS _role", "coalesce(text, ' ') AS _text", f"{fault} AS _fault"
        )
        .filter("_fault <> 0")
        .selectExpr("conv_id", "turn", "if(_fault = 4, 'user', _role) AS role", text, "if(_fault = 3, 2, 1) AS _times")
        .selectExpr("conv_id", "turn", "role", "text", "explode(sequence(1, _times)) AS _time")
        .drop("_time")
    )


def _runs(rows: DataFrame) -> DataFrame:
    """Distinct turns with the number of their copies and their first fault, sorted into ranges and written."""
    bare = "trim(TRAILING ' \\t\\n\\u000b\\f\\r' FROM text)"
    initial = "substring(role, 1, 1)"
    turns = rows.selectExpr(
        "conv_id",
        "turn",
        "role",
        "digest",
        f"if({initial} IN ('s', 'u', 'a'), {initial}, 'o') AS initial",
        f"{bare} = '' AS blank",
        f"substring({bare}, -1, 1) NOT IN ('.', '!', '?') AS truncated",
    )
    turns = turns.groupBy(*turns.columns).agg(F.count(F.lit(1)).alias("copies"))
    # Of turns with the same role and text, only one without number or with the least is the first.
    turns = turns.withColumn("_said", F.struct("conv_id", "role", "digest"))
    first = turns.groupBy("_said").agg(
        F.max(F.col("turn").isNull()).alias("_unnumbered"), F.min("turn").alias("_first")
    )
    turns = attach(turns, first, "_said", "turn").withColumn(
        "again", F.expr("turn IS NOT NULL AND (_unnumbered OR turn > _first)")
    )
    order = ["conv_id", "turn", "role", "digest"]
    turns = turns.select(*order, "initial", "blank", "truncated", "again", "copies")
    return checkpointed(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def _stretches(runs: DataFrame, kind: str) -> DataFrame:
    """One row per conversation and range: its turns, or what leads through them if they are many."""
    schema = (
        f"conv_id {kind}, part int, turns string, ways array<struct<start int, end int, cost bigint, audit string>>,"
        " illegal bigint, first string, last string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        turns: list[str] = []
        illegal, first, last = 0, "", ""

        def row() -> dict:
            text = "".join(turns)
            ways = None
            if len(text) > WHOLE:
                ways = [
                    {"start": s, "end": e, "cost": cost, "audit": audit}
                    for (s, e), (cost, audit) in matrix(text).items()
                ]
                text = None
            own = {"conv_id": held[0], "part": held[1], "turns": text, "ways": ways}
            return own | {"illegal": illegal, "first": first, "last": last}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = r["conv_id"], r["part"]
                if key != held:
                    if held is not None:
                        out.append(row())
                    held, turns, illegal, first, last = key, [], 0, r["initial"], ""
                gone = r["blank"] or r["again"]
                turns.append("-" if gone else r["initial"].upper() if r["truncated"] else r["initial"])
                turns.append("-" * (r["copies"] - 1))
                illegal += (last + r["initial"] not in ("su", "ua", "au")) if last else 0
                illegal += r["copies"] - 1
                last = r["initial"]
            yield pa.RecordBatch.from_pylist(out, arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([row()], arrow)

    arrow = _arrow(runs, schema)
    sorted_ = runs.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    return sorted_.mapInArrow(run, schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def _audits(stretches: DataFrame, kind: str) -> DataFrame:
    """conv_id, cost, audit and illegal of every conversation, and the part of the audit of each range."""
    schema = (
        f"conv_id {kind}, cost bigint, audit string, illegal bigint,"
        " parts array<struct<part int, place bigint, audit string>>"
    )

    def audit(stretches: list[dict]) -> dict:
        ways: dict[int, tuple[Way, tuple[str, ...]]] = {START: ((0, ""), ())}
        illegal, last = 0, ""
        for stretch in stretches:
            if stretch["turns"] is None:
                through = {(w["start"], w["end"]): (w["cost"], w["audit"]) for w in stretch["ways"]}
            else:
                through = matrix(stretch["turns"], tuple(sorted(ways)))
            further: dict[int, tuple[Way, tuple[str, ...]]] = {}
            for (start, end), (cost, text) in through.items():
                if start in ways:
                    (before, ahead), parts = ways[start]
                    own = (before + cost, ahead + text), (*parts, text)
                    further[end] = min(further.get(end, own), own)
            ways = further
            illegal += stretch["illegal"] + bool(last and last + stretch["first"] not in ("su", "ua", "au"))
            last = stretch["last"]
        (cost, whole), texts = min(ways[end] for end in ENDS if end in ways)
        parts, place = [], 0
        for stretch, text in zip(stretches, texts, strict=True):
            parts.append({"part": stretch["part"], "place": place, "audit": text})
            place += len(text) - text.count("D")
        return {"cost": cost, "audit": whole, "illegal": illegal, "parts": parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"]} | audit(r["stretches"]) for r in rows], arrow)

    arrow = _arrow(stretches, schema)
    # At most one stretch per range.
    whole = stretches.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "turns", "ways", "illegal", "first", "last"))).alias("stretches")
    )
    return whole.mapInArrow(run, schema)


def _edits(audits: DataFrame, kind: str) -> DataFrame:
    """One row per turn that is kept, changed or inserted: its range and number there, place, new role, edit."""
    schema = f"conv_id {kind}, part int, at bigint, place bigint, new_role string, edit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at, place, odd = 0, r["place"], r["total"] % 2
                for edit in r["audit"]:
                    if edit != "D":
                        # Of an even number of turns the even ones are the user's, else the odd ones.
                        role = ROLES["ua"[(place + odd) % 2]] if edit != "K" else None
                        own = (r["conv_id"], r["part"], at if edit != "I" else None, place, role, edit)
                        out.append(dict(zip(arrow.names, own, strict=True)))
                        place += 1
                    at += edit != "I"
                    if len(out) >= EXPANDED:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
            yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = _arrow(audits, schema)
    parts = audits.selectExpr("conv_id", "length(replace(audit, 'D', '')) AS total", "inline(parts)")
    return parts.repartition("conv_id", "part").mapInArrow(run, schema)


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and the cheapest repair, and the repaired turns.

    The first table has conv_id, gaps (numbers missing between the least and the greatest turn),
    blank, duplicate and truncated (turns by their first fault), illegal (neighbours whose roles may
    not follow each other), cost and audit. The second has conv_id, place (from 0), turn (NULL if
    inserted), role, text and edit.

    Turns are read by number, those without number first, and those with the same number by role and
    digest of the text. A NULL role or text is one space; a NULL conversation is one like others. Rows
    that repeat everything follow each other, all but the first as duplicates. A conversation all of
    whose turns go has no repaired turns. An empty table gives no rows. Other columns are ignored,
    whatever their names. An audit is one string, which bounds a conversation to some 10^9 turns.
    """
    kind = dict(conversations.dtypes)[conv_col]
    rows = conversations.selectExpr(
        f"`{conv_col}` AS conv_id", f"`{turn_col}` AS turn", f"coalesce(`{role_col}`, ' ') AS role",
        f"coalesce(`{text_col}`, ' ') AS text",
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    runs = _runs(rows)
    audits = checkpointed(_audits(_stretches(runs, kind), kind))

    numbers = runs.select("conv_id", "turn").distinct().groupBy("conv_id")
    parts = [
        audits.select("conv_id", "cost", "audit", "illegal"),
        numbers.agg(F.expr("coalesce(max(turn) - min(turn) + 1 - count(turn), 0L) AS gaps")),
        runs.groupBy("conv_id").agg(
            F.expr("sum(if(blank, copies, 0L)) AS blank"),
            F.expr("sum(CASE WHEN blank THEN 0L WHEN again THEN copies ELSE copies - 1 END) AS duplicate"),
            F.count_if(F.expr("NOT blank AND NOT again AND truncated")).alias("truncated"),
        ),
    ]
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    faults = stacked(parts, names)

    edits = checkpointed(_edits(audits, kind))
    before = "OVER (PARTITION BY conv_id, part ORDER BY turn, role, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    numbered = runs.selectExpr("*", f"sum(copies) {before} - copies AS at").filter("NOT blank AND NOT again")
    kept = numbered.selectExpr(
        "struct(conv_id, part, at) AS _at", "turn", "role AS old_role", "struct(conv_id, turn, role, digest) AS _row"
    ).join(edits.filter("at IS NOT NULL").withColumn("_at", F.expr("struct(conv_id, part, at)")), "_at")
    # One text per distinct turn; copies are combined before they travel.
    texts = rows.selectExpr("struct(conv_id, turn, role, digest) AS _row", "text").groupBy("_row").agg(F.max("text").alias("text"))
    kept = kept.join(texts, "_row").selectExpr(
        "conv_id", "place", "turn", "coalesce(new_role, old_role) AS role", "text", "edit"
    )
    turn_kind = dict(conversations.dtypes)[turn_col]
    inserted = edits.filter("at IS NULL").selectExpr(
        "conv_id", "place", f"CAST(NULL AS {turn_kind}) AS turn", "new_role AS role", "'' AS text", "edit"
    )
    return faults, kept.unionByName(inserted)


def stacked(parts: list[DataFrame], names: tuple[str, ...]) -> DataFrame:
    """Columns of tables with a row per conv_id at most, put side by side; NULL where none has a value."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("conv_id").agg(*[F.max(n).alias(n) for n in names])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the digest of ``role:text`` of the turns in order, one per line.

    A conversation is read turn by turn, so its length doesn't matter for memory.
    """
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                line = f"{r['role']}:{r['text']}".encode()
                if digest is not None and r["conv_id"] == held:
                    digest.update(b"\n" + line)
                    continue
                if digest is not None:
                    out.append({"conv_id": held, "repaired_sha256": digest.hexdigest()})
                held, digest = r["conv_id"], hashlib.sha256(line)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": held, "repaired_sha256": digest.hexdigest()}], arrow)

    arrow = _arrow(turns, schema)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)
