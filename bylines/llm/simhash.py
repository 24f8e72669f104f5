"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Fingerprints that differ in at most two bits
differ in at most one bit of the first segment, or not at all in the second. So every fingerprint
looks up the Hamming ball of radius 1 around its first segment (33 values) and its second segment
itself in a table of segment values; what it meets there is verified by the complete distance.

Segment values that more than ``CROWD`` fingerprints share, as in a large family of near copies,
would yield pairs by the square of their number. Fingerprints that look up such a value enumerate
the ball of radius 1 around the complete fingerprint instead: two of them differ in at most two bits
if and only if these balls meet. A point lies in 65 balls at most, whatever the data, and those who
meet at a point are linked to the smallest of them. Neither way leaves out a link between components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import attach, checkpointed, map_text, one_of_each, repeated, texts
from bylines.llm.components import components
from bylines.operators.joins import unused

SHINGLE = 3  # words
SEED = 42
DISTANCE = 2  # bits; the two tables below are laid out for it
CROWD = 64  # fingerprints that share a segment value, from which on they meet by whole balls


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of the word shingles, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``counts`` hashes: bits set in over half of them; zero for an empty run."""
    found = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for bit in range(64):
            place = np.uint64(bit)
            ones = np.add.reduceat((hashes >> place) & np.uint64(1), starts)
            found[full] |= (2 * ones > counts[full].astype(np.uint64)).astype(np.uint64) << place
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (bigint) and text_hash of every row; NULL and texts without words have fingerprint 0."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def fingerprint(part: pa.RecordBatch) -> pa.RecordBatch:
            hashes, counts = [], []
            for text in texts(part):
                own = shingle_hashes(text, size)
                hashes.append(np.array(own, np.uint64))
                counts.append(len(own))
            joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            found = pa.array(majorities(joined, np.array(counts, np.int64)).view(np.int64))
            columns = [part.column("doc_id"), found, part.column("text_hash")]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "text_hash"])

        return fingerprint

    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text", f"xxhash64(`{text_col}`) AS text_hash")
    return map_text(rows, work, f"doc_id {kind}, fingerprint bigint, text_hash bigint")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links a < b that connect the distinct fingerprints (column fingerprint) at DISTANCE or fewer bits."""
    first, second = "shiftrightunsigned(fingerprint, 32)", "(fingerprint & 4294967295L)"
    ball = f"transform(sequence(0, 31), i -> struct({first} ^ shiftleft(1L, i) AS value, false AS own))"
    probes = prints.selectExpr(
        "fingerprint",
        f"inline(concat(array(struct({first} AS value, true AS own),"
        f" struct({second} | 4294967296L AS value, true AS own)), {ball}))",
    )
    sizes = probes.filter("own").groupBy("value").agg(F.count(F.lit(1)).alias("_size"))
    met = attach(probes, sizes, "value", "fingerprint").filter("_size > 0")

    rare = met.filter(f"_size <= {crowd}")
    entries = rare.filter("own").selectExpr("value", "fingerprint AS other")
    pairs = rare.join(entries, "value").selectExpr("fingerprint AS a", "other AS b")

    crowded = met.filter(f"_size > {crowd}").select("fingerprint").distinct()
    points = "concat(array(fingerprint), transform(sequence(0, 63), i -> fingerprint ^ shiftleft(1L, i)))"
    meeting = (
        crowded.selectExpr("fingerprint", f"explode({points}) AS point")
        .groupBy("point")
        .agg(F.collect_list("fingerprint").alias("there"))  # 65 at most
        .filter("size(there) > 1")
        .selectExpr("array_min(there) AS a", "explode(there) AS b")
    )
    near = f"a <> b AND bit_count(a ^ b) <= {DISTANCE}"
    return pairs.unionByName(meeting).filter(near).selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, crowd: int = CROWD
) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id of its component, for every row.

    Texts without words, NULL ones included, have fingerprint 0 and are linked like any other. A
    component whose rows all lack an id has a NULL component_id. Rows that repeat a document lie in
    its component. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    found = _classes(docs, id_col, text_col, size, crowd)
    return repeated(found.select("doc_id", "fingerprint", "component_id", "copies"), "copies")


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, crowd: int) -> DataFrame:
    """doc_id, fingerprint, text_hash, root (a fingerprint of the component), component_id and copies.

    Rows that repeat id and text are one.
    """
    found = checkpointed(fingerprints(docs, id_col, text_col, size))
    prints = found.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fingerprint"), crowd)).withColumnRenamed("node", "fingerprint")
    rooted = prints.join(roots, "fingerprint", "left").selectExpr(
        "fingerprint", "first", "coalesce(root, fingerprint) AS root"
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    values = attach(rooted.select("fingerprint", "root"), smallest, "root", "fingerprint")
    apart = found.groupBy("doc_id", "fingerprint", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    apart = apart.withColumn("_spread", F.xxhash64("doc_id", "text_hash"))
    return attach(apart, values, "fingerprint", "_spread").drop("_spread")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, crowd: int = CROWD
) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: the row with the smallest id.

    In a component without any id it is the row with the smallest hash of its text, and so among rows
    that share the smallest id. Of rows that repeat id and text one stays, whichever of them. An empty
    table gives no rows. Columns may have any names.
    """
    number, digest, copies = unused(["_id", "_hash", "_copies"], docs.columns)
    rows = _classes(docs, id_col, text_col, size, crowd).filter("doc_id <=> component_id")
    least = rows.groupBy("root").agg(F.min("text_hash").alias("_least"))
    # Only the least id's rows are left, or those of components without ids: dealt over shares as before.
    rows = rows.withColumn("_spread", F.xxhash64("doc_id", "text_hash"))
    kept = attach(rows, least, "root", "_spread").filter("text_hash = _least")
    kept = kept.select(F.col("doc_id").alias(number), F.col("text_hash").alias(digest), F.col("copies").alias(copies))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(number)) & (F.xxhash64(f"`{text_col}`") == F.col(digest))
    return one_of_each(docs.join(kept, same), [number, digest], copies).drop(number, digest, copies)
