"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark items; items shorter than a window are patterns
as a whole. For each pattern length a machine holds

* a shift table: for every block of ``BLOCK`` words in a pattern, how far the block lies from the
  pattern's end. A block that no pattern holds lets the search skip to where it no longer matters.
  The table is indexed by a hash; blocks that share a place have the least of their shifts, so the
  search may skip less than it could, never more;
* buckets by the hashes of the last block (shift 0) and the first one, of the patterns to compare.

All this is kept in arrays, some 35 bytes per byte of benchmark text while they are built; the patterns themselves are
places in the benchmark's words. A bucket's patterns are compared word by word, so hits are exact.
Documents stay where they are: the machines travel to them, and a Python worker builds them once. The
benchmark goes out in blocks of at most ``block_bytes`` of text, one after the other, so that a task
never holds more than one block's machines.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import checkpointed, map_text, per_worker, texts

WINDOW = 10  # words
BLOCK = 3  # words of a block, fewer for shorter patterns
BLOCK_BYTES = 8 << 20  # benchmark text that is searched for at a time

MOST_SLOTS = 25  # bits of the index of a shift table
WORD, MIX = 2**64 - 1, 0x9E3779B97F4A7C15

# A-Z become a-z, letters, digits and all bytes beyond ASCII stay, the rest separates words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

FOUND = "array<struct<first: int, last: int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Machine:
    """Shift table and buckets for patterns of one length: windows of the parts (first word, words, item) of ``flat``."""

    def __init__(self, size: int, flat: list[bytes], parts: list[tuple[int, int, object]]):
        self.size, self.flat = size, flat
        self.block = min(BLOCK, size)
        self.skip = size - self.block + 1
        first, count = (np.array([part[i] for part in parts], np.int64) for i in (0, 1))
        at, inside = _ranges(first, count - self.block + 1)
        hashes = np.fromiter((hash(b" ".join(flat[i : i + self.block])) for i in at.tolist()), np.int64, len(at))
        slots = 1 << min(MOST_SLOTS, max(10, (16 * len(at)).bit_length()))
        self.mask = slots - 1
        shift = np.full(slots, self.skip, np.uint8)
        np.minimum.at(shift, hashes & self.mask, (self.skip - 1 - np.minimum(inside, self.skip - 1)).astype(np.uint8))
        self.shift = shift.tobytes()

        begins, _ = _ranges(first, count - size + 1)
        owners = np.repeat(np.arange(len(parts)), count - size + 1)
        place = np.searchsorted(at, begins)  # both rise
        keys = hashes[place + self.skip - 1].view(np.uint64) * np.uint64(MIX) + hashes[place].view(np.uint64)
        order = np.argsort(keys, kind="stable")
        self._group(keys[order], begins[order], owners[order], [part[2] for part in parts])

    def _group(self, keys: np.ndarray, begins: np.ndarray, owners: np.ndarray, ids: list) -> None:
        """One entry per distinct pattern, by key, with the items that hold it."""
        entry = np.arange(len(keys))
        same = np.append(False, keys[1:] == keys[:-1])
        seen: dict[tuple[bytes, ...], int] = {}
        for i in np.flatnonzero(same).tolist():
            if not same[i - 1]:
                seen = {self._pattern(begins[i - 1]): i - 1}
            entry[i] = seen.setdefault(self._pattern(begins[i]), i)
        kept, which = np.unique(entry, return_inverse=True)
        self.keys, self.begins = array("Q", keys[kept].tobytes()), array("q", begins[kept].tobytes())
        pairs = np.unique(np.stack([which, owners], axis=1), axis=0)
        self.ids = ids
        self.owners = array("q", pairs[:, 1].tobytes())
        self.owned = array("q", np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1)).tobytes())

    def _pattern(self, begin: int) -> tuple[bytes, ...]:
        return tuple(self.flat[begin : begin + self.size])

    def search(self, words: list[bytes], hit: bytearray, items: set) -> None:
        """Mark the words inside occurrences in ``hit`` and add the items found."""
        block, size, shift, mask, keys = self.block, self.size, self.shift, self.mask, self.keys
        end, count = size, len(words)
        while end <= count:
            last = hash(b" ".join(words[end - block : end]))
            far = shift[last & mask]
            if far:
                end += far
                continue
            start = end - size
            key = ((last & WORD) * MIX + (hash(b" ".join(words[start : start + block])) & WORD)) & WORD
            at = bisect_left(keys, key)
            while at < len(keys) and keys[at] == key:
                begin = self.begins[at]
                if words[start:end] == self.flat[begin : begin + size]:
                    hit[start:end] = b"\1" * size
                    owners = self.owners[self.owned[at] : self.owned[at + 1]]
                    items.update(item for owner in owners if (item := self.ids[owner]) is not None)
                at += 1
            end += 1


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first one on, end to end, and how far each is from it."""
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + inside, inside


def machines(benchmark: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[Machine]:
    """One machine per pattern length for (item_id, text) rows."""
    flat: list[bytes] = []
    once: dict[bytes, bytes] = {}
    parts: dict[int, list[tuple[int, int, object]]] = defaultdict(list)
    for item, text in benchmark:
        words = [once.setdefault(w, w) for w in words_of((text or "").encode())]
        if words:
            parts[min(window, len(words))].append((len(flat), len(words), item))
            flat += words
    return [Machine(size, flat, own) for size, own in parts.items()]


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_bytes`` of text, dealt by a hash of its rows."""
    rows = benchmark.selectExpr(f"`{item_id}` AS item", f"`{text}` AS text").filter("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-2 * total // block_bytes) if total > block_bytes else 1
    return [rows.filter(f"pmod(xxhash64(item, text), {parts}) = {k}") for k in range(parts)]


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words, both ends inclusive) and items of every document.

    NULL or empty texts have no words; items without words are no patterns. An item without id
    marks words but is in no list. Items that repeat count once by their id. Rows that repeat a
    document each get its result. An empty benchmark hits nothing. Other columns are ignored.
    """
    kind = dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, text string, n_words bigint, spans {FOUND}, items array<{kind}>"
    state = docs.selectExpr(
        f"`{id_col}` AS doc_id",
        f"`{text_col}` AS text",
        "0L AS n_words",
        f"CAST(array() AS {FOUND}) AS spans",
        f"CAST(array() AS array<{kind}>) AS items",
    )
    blocks = blocks_of(benchmark, item_id, item_text, block_bytes)
    for block in blocks:
        items = [tuple(row) for row in block.collect()]  # at most about block_bytes
        state = map_text(state, _search(items, window), schema)
        if len(blocks) > 1:
            state = checkpointed(state)
    return state.drop("text")


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    blocks = blocks_of(benchmark, item_id, item_text, block_bytes)
    for block in blocks:
        items = [tuple(row) for row in block.collect()]  # at most about block_bytes
        docs = map_text(docs, _without(items, window, text_col), docs.schema, text_col)
        if len(blocks) > 1:
            docs = checkpointed(docs)
    return docs


def _without(items: list, window: int, text_col: str) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    key = ("machines", uuid.uuid4().hex)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        built = per_worker(key, lambda: machines(items, window))

        def clean(part: pa.RecordBatch) -> pa.RecordBatch:
            free = []
            for text in texts(part, text_col):
                words = words_of(text)
                hit = bytearray(len(words))
                for machine in built:
                    machine.search(words, hit, set())
                free.append(1 not in hit)
            return part.filter(pa.array(free, pa.bool_()))

        return clean

    return work


def _search(items: list, window: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    key = ("machines", uuid.uuid4().hex)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        built = per_worker(key, lambda: machines(items, window))

        def scan(part: pa.RecordBatch) -> pa.RecordBatch:
            counts, spans, found = [], [], []
            before = zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)
            for text, (old, known) in zip(texts(part), before, strict=True):
                words = words_of(text)
                hit, of = bytearray(len(words)), set(known)
                for machine in built:
                    machine.search(words, hit, of)
                for run in old:
                    hit[run["first"] : run["last"] + 1] = b"\1" * (run["last"] + 1 - run["first"])
                counts.append(len(words))
                spans.append(runs(hit))
                found.append(sorted(of))
            names = part.schema.names
            new = {"n_words": counts, "spans": spans, "items": found}
            arrays = [
                pa.array(new[n], part.schema.field(n).type) if n in new else part.column(n) for n in names
            ]
            return pa.RecordBatch.from_arrays(arrays, names)

        return scan

    return work


def runs(hit: bytearray) -> list[dict[str, int]]:
    """Runs of ones, as first and last position."""
    found, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        found.append({"first": at, "last": end - 1})
        at = hit.find(1, end)
    return found


def items_digest(items: str = "items") -> str:
    """SQL: SHA-256 of the ids, sorted as strings and joined by commas."""
    return f"sha2(array_join(array_sort(transform({items}, i -> CAST(i AS string))), ','), 256)"
