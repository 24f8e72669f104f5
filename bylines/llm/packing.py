"""Packing documents into sequences by order-preserving dynamic programming.

The documents of a partition lie end to end in their order. A cut may fall behind a document (free),
behind a sentence (``SENTENCE``) or, so that no stretch is without one, every ``STEP`` tokens inside
a long sentence (``INSIDE``); the penalties are in tokens of padding. A sequence lies between two
cuts at most ``limit`` tokens apart and costs its padding and the penalty of the cut behind it. The
cheapest way to a cut is the smallest ``cost + position`` among the cuts one sequence back, which a
monotone queue yields in constant time per cut.

The programme runs over stretches of ``STRETCH`` tokens: the best way to the end of a stretch is kept
up to its last cut, and what lies behind joins the next stretch, so memory is bounded. Only the last
sequence of a partition may be left short. It is cut into lengths that are powers of two, which need
no padding, if that costs less than padding it.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from bylines.llm.common import text_slices

LIMIT = 2048  # tokens of a sequence
END = 1  # id behind every document
SENTENCE = 8  # penalties of cuts, in tokens of padding
INSIDE = 48
STEP = 32  # most tokens between two places for a cut
STRETCH = 1 << 18  # tokens that the programme looks at together
# Fixed value: the vocabulary's pre-tokeniser, with possessive quantifiers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PLAIN = regex.compile(r"[^\x00-\u024f\u2000-\u206f]")  # beyond it tokenizers does the work

SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def encoder(vocabulary: str, ranks: str) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizers library gives them for ``vocabulary``.

    The same vocabulary as ``ranks`` is encoded several times faster by tiktoken. Texts with special
    strings, or with characters on which the two libraries' Unicode tables might differ, go through
    tokenizers.
    """
    exact = Tokenizer.from_file(vocabulary)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if PLAIN.search(text) or any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def sentence_ends(vocabulary: str) -> np.ndarray:
    """For every id, whether a sentence may end behind it: full stop, question or exclamation mark, line end."""
    exact = Tokenizer.from_file(vocabulary)
    size = exact.get_vocab_size(with_added_tokens=True)
    strings = [exact.decode([i], skip_special_tokens=False) for i in range(size)]
    return np.array([s.rstrip(" \"')")[-1:] in (".", "!", "?") or "\n" in s for s in strings])


def places(ids: np.ndarray, ends: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a cut may fall, with penalties; ``documents`` are the positions behind documents."""
    known = ids < len(ends)
    sentence = np.flatnonzero(ends[np.where(known, ids, 0)] & known) + 1
    natural = np.union1d(sentence, documents)
    gaps = np.diff(natural, prepend=0)
    more = (gaps - 1) // STEP  # places inside the stretch before each natural one
    total = int(more.sum())
    nth = np.arange(total) - np.repeat(np.cumsum(more) - more, more) + 1
    inside = np.repeat(natural - gaps, more) + nth * STEP
    at = np.concatenate([natural, inside])
    penalty = np.concatenate([np.where(np.isin(natural, documents), 0, SENTENCE), np.full(total, INSIDE)])
    order = np.argsort(at, kind="stable")
    return at[order], penalty[order]


def best_cuts(at: np.ndarray, penalty: np.ndarray, limit: int) -> list[int]:
    """Cuts of the cheapest way from 0 to one of the places in the last ``limit`` tokens."""
    position = [0, *at.tolist()]
    extra = [0, *penalty.tolist()]
    cost, back = [0] * len(position), [0] * len(position)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, place), both rising
    for j in range(1, len(position)):
        here = position[j]
        while position[queue[0][1]] < here - limit:
            queue.popleft()
        value, back[j] = queue[0]
        cost[j] = own = value + limit - here + extra[j]
        own += here
        while queue and queue[-1][0] >= own:
            queue.pop()
        queue.append((own, j))
    least = position[-1] - limit
    last = min((j for j in range(len(position) - 1, -1, -1) if position[j] > least), key=cost.__getitem__)
    cuts = []
    while last:
        cuts.append(position[last])
        last = back[last]
    return cuts[::-1]


def tail_cuts(length: int, limit: int) -> list[int]:
    """Cuts of the last sequence of a partition: whole, or in powers of two from the largest."""
    powers = [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]
    if (len(powers) - 1) * INSIDE >= limit - length:
        return [length]
    return np.cumsum(powers).tolist()


class Packer:
    """Takes documents in order and returns the pieces of finished sequences."""

    def __init__(self, ends: np.ndarray, first: int, limit: int, stretch: int):
        self.ends, self.sequence, self.limit, self.stretch = ends, first, limit, stretch
        self.ids: list[np.ndarray] = []
        self.documents: list[tuple[object, int, int, int]] = []  # id, ids before, ids here, ids in all
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> list[tuple]:
        self.ids.append(ids)
        self.documents.append((doc_id, 0, len(ids), len(ids)))
        self.held += len(ids)
        return self.pack() if self.held >= self.stretch else []

    def pack(self, final: bool = False) -> list[tuple]:
        if not self.held:
            return []
        ids = np.concatenate(self.ids)
        sizes = np.array([d[2] for d in self.documents], np.int64)
        behind = np.cumsum(sizes)
        cuts = best_cuts(*places(ids, self.ends, behind), self.limit)
        done = cuts[-1] if cuts else 0
        if final and done < len(ids):
            cuts += [done + c for c in tail_cuts(len(ids) - done, self.limit)]
            done = cuts[-1]
        rows = self._pieces(ids, behind, np.array(cuts, np.int64))
        kept = int(np.searchsorted(behind, done, side="right"))  # documents that are finished
        rest = self.documents[kept:]
        if rest:
            doc_id, before, here, total = rest[0]
            cut = done - (int(behind[kept]) - here)
            rest[0] = (doc_id, before + cut, here - cut, total)
        self.documents, self.ids, self.held = rest, [ids[done:].copy()], len(ids) - done
        return rows

    def _pieces(self, ids: np.ndarray, behind: np.ndarray, cuts: np.ndarray) -> list[tuple]:
        if not len(cuts):
            return []
        ends = np.union1d(cuts, behind[behind <= cuts[-1]])
        starts = np.concatenate([[0], ends[:-1]])
        documents = np.searchsorted(behind, starts, side="right").tolist()
        sequences = np.searchsorted(cuts, starts, side="right")
        offsets = starts - np.concatenate([[0], cuts])[sequences]
        rows, data = [], memoryview(ids.astype("<u4")).cast("B")
        for a, b, d, s, offset in zip(
            starts.tolist(), ends.tolist(), documents, sequences.tolist(), offsets.tolist(), strict=True
        ):
            doc_id, before, here, total = self.documents[d]
            start = before + a - (int(behind[d]) - here)
            rows.append((doc_id, start, b - a, zlib.crc32(data[4 * a : 4 * b]), total, self.sequence + s, offset))
        self.sequence += len(cuts)
        return rows


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold documents in the order of their partition and never cross partitions, so nothing
    is shuffled. ``sequence_id`` is the partition's number times 2^40 and a count. NULL and empty
    texts are the end id alone. Rows that repeat a document are packed again each. A text of any
    length is cut into as many sequences as it takes. An empty table gives no rows. ``vocabulary``
    and ``ranks`` are files at the same place on every executor. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(vocabulary, ranks), sentence_ends(vocabulary)
        packer = Packer(ends, TaskContext.get().partitionId() << 40, limit, stretch)
        types: list[pa.DataType] = []

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            types = [batch.schema.field("doc_id").type, *[pa.int64()] * (len(names) - 1)]
            for part in text_slices(batch, "text"):
                rows = []
                for doc_id, text in zip(
                    part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True
                ):
                    rows += packer.add(doc_id, np.array([*encode(text or ""), END], np.uint32))
                yield from out(rows)
        yield from out(packer.pack(final=True))

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(work, f"doc_id {kind}, {SCHEMA}")
