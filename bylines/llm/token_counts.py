"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of arrays.

Texts are cut into pre-tokens. The distinct pre-tokens of a batch that are not yet known lie end to
end in one array of symbols, a ragged batch. In each round every sequence finds the lowest rank among
its neighbouring pairs and applies it wherever it stands; all sequences do so at once, in a few
vector operations. A sequence without a ranked pair is done, and its symbols are counted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bylines.llm.common import map_text

# Unicode white space, and how the vocabulary's byte-level pre-tokeniser cuts texts.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

KNOWN = 400_000  # pre-tokens whose counts a task remembers; beyond it the memory starts anew
NEVER = np.int32(2**31 - 1)  # rank of a pair that isn't merged
SLOTS = 1 << 18  # of the table of pairs; doubled until it is at most a quarter full


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pairs:
    """Ranks of symbol pairs in a table with open addressing, looked up by arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.size = SLOTS
        while self.size < 4 * len(left):
            self.size *= 2
        self.keys = np.full(self.size, -1, np.int64)
        self.ranks = np.full(self.size, NEVER, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        todo, slots = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = self.keys[slots[todo]] < 0
            self.keys[slots[todo[free][::-1]]] = keys[todo[free][::-1]]
            placed = self.keys[slots[todo]] == keys[todo]
            self.ranks[slots[todo[placed]]] = todo[placed]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) % self.size

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.size.bit_length() + 1)).astype(np.int64)

    def ranks_of(self, symbols: np.ndarray) -> np.ndarray:
        """The rank of each symbol with the next one."""
        keys = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
        slots = self._slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.ranks[slots], NEVER)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % self.size
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found


class Vocabulary:
    """Byte-level BPE from a tokenizers file, given by its path."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        ids = parts["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.byte_ids = np.array([ids[s] for _, s in sorted(byte_symbols().items())], np.int32)
        self.pairs = Pairs(*(np.array([ids[m[i]] for m in merges]) for i in (0, 1)))
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Number of symbols that each pre-token (not empty) is left with."""
        symbols = self.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        done, which = lengths.copy(), np.arange(len(pretokens))
        while len(which):
            starts = np.cumsum(lengths) - lengths
            ranks = np.append(self.pairs.ranks_of(symbols), NEVER)
            ranks[starts[1:] - 1] = NEVER
            best = np.minimum.reduceat(ranks, starts)
            going = best < NEVER
            if not going.all():
                done[which[~going]] = lengths[~going]
                inside = np.repeat(going, lengths)
                symbols, ranks = symbols[inside], ranks[inside]
                which, lengths, best = which[going], lengths[going], best[going]
                if not len(which):
                    break
            owner = np.repeat(np.arange(len(lengths)), lengths)
            at = np.flatnonzero(ranks == best[owner])
            # Of pairs that overlap (a run of one symbol) every other one is merged, from the left.
            index = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, index, 0))
            at = at[(index - first) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            lengths = lengths - np.bincount(owner[at], minlength=len(lengths))
            symbols = np.delete(symbols, at + 1)
        return done


def token_counter(path: str, known: int = KNOWN) -> Callable[[Iterable[str]], list[int]]:
    """A function from texts to their numbers of tokens; special strings in a text are one token each."""
    vocabulary, find = Vocabulary(path), regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
    memory: dict[str, int] = {}

    def count(texts: Iterable[str]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            parts = special.split(text)
            cut.append(find(text) if len(parts) == 1 else [w for p in parts for w in find(p)])
            extra.append(len(parts) - 1)
        if len(memory) > known:
            memory.clear()
        new = list(set(chain.from_iterable(cut)).difference(memory))
        if new:
            memory.update(zip(new, vocabulary.counts([w.encode() for w in new]).tolist(), strict=True))
        return [n + sum(map(memory.__getitem__, words)) for words, n in zip(cut, extra, strict=True)]

    return count


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row; NULL and empty texts have 0 of both.

    ``path`` is the vocabulary file, at the same place on every executor. Other columns are ignored.
    """

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counter = token_counter(path)

        def count(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in part.column("text").to_pylist()]
            tokens = pa.array(counter(texts), pa.int64())
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, tokens], ["doc_id", "n_bytes", "n_tokens"])

        return count

    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return map_text(rows, work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
