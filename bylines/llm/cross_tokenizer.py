"""Alignment of the tokens that two tokenizers make of the same text, with corpus-wide counts of linked ids.

Both token sequences spell the same bytes. Where an A and a B token end at the same byte, they are
linked, and the places cut the sequences into groups. Of two tokens that end together the shorter
spells the end of the longer, so the vocabularies themselves bound the number of distinct pairs of
linked ids (``most_pairs``: 324,297 here), whatever the corpus. What follows rests on that bound.

1. A first pass aligns all documents and keeps, per task, the pairs it met and their numbers.
2. The distinct pairs get a minimal perfect hash: a key takes the place it has for itself in a bit
   table, keys that collide go on to a smaller table, and the rank of a bit is the key's index.
3. Each task's numbers are added into dense vectors indexed by that hash; these are summed in a tree,
   first of tasks, then by blocks of the vector.
4. A second pass aligns the documents again and looks the counts up; a key is compared with the one
   that has its index, so a pair that isn't in the table can't borrow another's count.

Texts are cut in front of spaces that follow a character other than white space. Neither tokenizer
joins anything across such a place: A's pre-tokeniser cuts there, and no piece of B has a space
behind another character (checked). So equal chunks are aligned once and remembered.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import checkpointed, map_text, per_worker, text_slices
from bylines.llm.packing import PATTERN, PLAIN
from bylines.llm.token_counts import byte_symbols

CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
BLOCK = 1 << 17  # chunks of a text that are looked at together
KNOWN = 700_000  # chunks that a task remembers
LONGEST = 64  # characters of a chunk that is remembered
TOGETHER = 1 << 20  # bytes of text whose chunks are aligned together
SLICE = 1 << 16  # entries of a count vector that travel together
SPREAD = 2.0  # bits per key in a level of the hash
SPECIAL = 1000  # ids beyond the tokens of text that special tokens may have
SPACE = "▁"  # B's sign for a space

SCHEMA = (
    "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


Ids = tuple[np.ndarray, np.ndarray]  # of all chunks end to end, and how many each has


class Vocabularies:
    """Both tokenizers, and the bytes that each of their ids stands for.

    Where A's ids are in the order of its merges, tiktoken gives the same ids several times faster;
    chunks on whose characters the two libraries' Unicode tables might differ go through tokenizers.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(a_path)
        self.exact.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        spelled = [*byte_of, *map("".join, merges)]
        self.a_bytes = {model["vocab"][s]: bytes(map(byte_of.__getitem__, s)) for s in spelled}
        in_order = [model["vocab"][s] for s in spelled[256:]] == list(range(256, len(spelled)))
        self.fast = None
        if in_order:
            ranks = {token: number for number, token in self.a_bytes.items()}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.fast = own.encode_ordinary
        size = self.b.get_piece_size()
        plain = [i for i in range(size) if not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.b_bytes = {i: self._piece(i) for i in plain}
        self.separable = not any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in plain)
        self.spell_a, self.spell_b = (_by_id(t) for t in (self.a_bytes, self.b_bytes))
        self.sizes_a, self.sizes_b = (np.array(list(map(len, t))) for t in (self.spell_a, self.spell_b))
        # Ids as text, by 2 * id + whether it ends its group, first A's, then B's.
        self.b_from = 2 * (max(self.a_bytes) + 1)
        self.signs = [f"{i}{sign}" for i in range(max(self.a_bytes) + 1) for sign in ",|"]
        self.signs += [f"{i}{sign}" for i in range(size) for sign in ",;"]

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace(SPACE, " ").encode()

    def most_pairs(self) -> int:
        """The number of pairs (A id, B id) one of which spells the end of the other: no others can be linked."""
        ids_a, ids_b = (_by_bytes(t) for t in (self.a_bytes, self.b_bytes))
        longer_a = sum(ids_b.get(t[k:], 0) for t in self.a_bytes.values() for k in range(len(t)))
        return longer_a + sum(ids_a.get(t[k:], 0) for t in self.b_bytes.values() for k in range(1, len(t)))

    def chunks(self, text: str) -> Iterator[list[str]]:
        """Space and text, cut where neither tokenizer joins; bounded numbers of chunks at a time."""
        if not self.separable:
            yield [f" {text}"]
        elif len(text) < BLOCK:
            yield CHUNK.findall(f" {text}")
        else:
            found = (match[0] for match in CHUNK.finditer(f" {text}"))
            while block := list(islice(found, BLOCK)):
                yield block

    def encode(self, chunks: list[str]) -> tuple[Ids, Ids]:
        """A's and B's ids of chunks that begin with a space, which B adds by itself."""
        ids_b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        for i in [i for i, c in enumerate(chunks) if c == " "]:  # B adds no space to an empty text
            ids_b[i] = self.b.encode("x ")[len(self.b.encode("x")) :]
        if self.fast is None or PLAIN.search("".join(chunks)):
            return _flat([self._ids_a(c) for c in chunks]), _flat(ids_b)
        # A cuts between chunks unless white space meets white space there, so they can be encoded end to end.
        together = np.array([not c[-1].isspace() for c in chunks])
        joined = [c for c, ok in zip(chunks, together, strict=True) if ok]
        flat = np.array(self.fast("".join(joined)), np.int64)
        ends = np.cumsum(self.sizes_a[flat])
        stops = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in joined]), "right")
        if together.all():
            return (flat, np.diff(stops, prepend=0)), _flat(ids_b)
        own = iter(np.split(flat, stops[:-1]))
        return _flat([next(own).tolist() if ok else self._ids_a(c) for c, ok in zip(chunks, together, strict=True)]), _flat(ids_b)

    def _ids_a(self, chunk: str) -> list[int]:
        if self.fast is None or PLAIN.search(chunk):
            return self.exact.encode(chunk, add_special_tokens=False).ids
        return self.fast(chunk)


def _by_bytes(spelled: dict[int, bytes]) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for token in spelled.values():
        found[token] = found.get(token, 0) + 1
    return found


class Chunks:
    """Alignments of chunks, each made once and remembered by number.

    ``of`` returns the numbers of chunks. By number there are the tokens of A and B, the links, and
    whether both tokenizers spell the chunk; ``texts`` has the groups as text, each with ';' behind it.
    """

    def __init__(self, words: Vocabularies, known: int = KNOWN):
        self.words, self.known = words, known
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers = np.zeros((4, 0), np.int64)  # A tokens, B tokens, links, spelled
        self.uses = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)  # A << 32 | B, chunk by chunk
        self.texts: list[str] = []

    def forget(self) -> None:
        """Keep the newer half of what may be remembered, of short chunks that were met again."""
        if len(self.index) <= self.known:
            return
        again = self.uses > 1
        kept = [(c, i) for c, i in self.index.items() if again[i] and len(c) <= LONGEST][-self.known // 2 :]
        old, texts, links = self.numbers, self.texts, np.split(self.links, np.cumsum(self.numbers[2])[:-1])
        self._clear()
        chosen = [i for _, i in kept]
        self.index = {c: i for i, (c, _) in enumerate(kept)}
        self.numbers, self.uses = old[:, chosen], np.zeros(len(chosen), np.int64)
        self.links = np.concatenate([self.links, *(links[i] for i in chosen)])
        self.texts = [texts[i] for i in chosen]

    def of(self, chunks: list[str]) -> np.ndarray:
        new = list(set(chunks).difference(self.index))
        if new:
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))

    def spelled(self, chunks: list[str]) -> bool:
        numbers = self.of(chunks)
        return bool(self.numbers[3][numbers].all())

    def _learn(self, new: list[str]) -> None:
        words, raws = self.words, [c.encode() for c in new]
        (flat_a, count_a), (flat_b, count_b) = words.encode(new)
        spelled = _spelled(raws, flat_a, count_a, words.spell_a) & _spelled(raws, flat_b, count_b, words.spell_b)
        if not spelled.all():
            flat_a, flat_b = (f[np.repeat(spelled, n)] for f, n in ((flat_a, count_a), (flat_b, count_b)))
            count_a, count_b = count_a * spelled, count_b * spelled
        ends_a, ends_b = np.cumsum(words.sizes_a[flat_a]), np.cumsum(words.sizes_b[flat_b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        owner_a = np.repeat(np.arange(len(new)), count_a)
        links = np.bincount(owner_a[at_a], minlength=len(new))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.numbers = np.concatenate([self.numbers, [count_a, count_b, links, spelled]], axis=1)
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.links = np.concatenate([self.links, (flat_a[at_a] << 32) | flat_b[at_b]])
        last_a, last_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        group = np.concatenate([2 * (np.cumsum(x) - x) + side for side, x in enumerate((last_a, last_b))])
        codes = np.concatenate([2 * flat_a + last_a, words.b_from + 2 * flat_b + last_b])
        signs = list(map(words.signs.__getitem__, codes[np.argsort(group, kind="stable")].tolist()))
        stops = np.cumsum(count_a + count_b).tolist()
        self.texts += ["".join(signs[a:b]) for a, b in zip([0, *stops], stops, strict=False)]


def _by_id(spelled: dict[int, bytes]) -> list[bytes]:
    """What each id spells; for ids that aren't tokens of text, a byte that no text in UTF-8 has."""
    return [spelled.get(i, b"\xff") for i in range(max(spelled) + SPECIAL)]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())), count


def _spelled(raws: list[bytes], flat: np.ndarray, count: np.ndarray, table: list[bytes]) -> np.ndarray:
    """Whether the ids spell each chunk; they nearly always do, and then all are compared at once."""
    tokens = list(map(table.__getitem__, flat.tolist()))
    stops = np.cumsum(np.append(0, count))
    ends = np.append(0, np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))))[stops]
    if b"".join(tokens) == b"".join(raws) and (np.diff(ends) == np.fromiter(map(len, raws), np.int64, len(raws))).all():
        return np.ones(len(raws), bool)
    return np.array([b"".join(tokens[a:b]) == raw for a, b, raw in zip(stops[:-1], stops[1:], raws, strict=True)])


class PerfectHash:
    """A minimal perfect hash of distinct keys, and the keys in the order of their indices."""

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.keys = np.zeros(len(keys), np.int64)
        left, before = keys.astype(np.int64), 0
        while len(left):
            size = max(8, math.ceil(SPREAD * len(left)))
            place = self._places(left, len(self.bits), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(alone) - alone + before
            settled = alone[place]
            self.keys[rank[place[settled]]] = left[settled]
            self.bits.append(alone)
            self.ranks.append(rank)
            left, before = left[~settled], before + int(alone.sum())

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def indices(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for keys that aren't in the table."""
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            place = self._places(keys[todo], level, len(bits))
            settled = bits[place]
            found[todo[settled]] = ranks[place[settled]]
            todo = todo[~settled]
        there = found >= 0
        found[there] = np.where(self.keys[found[there]] == keys[there], found[there], -1)
        return found


def spelled_texts(words: Vocabularies, chunks: Chunks, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Place of a text and numbers of its chunks, in order, for those texts that both tokenizers spell.

    A long text comes in several parts, and is read twice, as it counts as a whole or not at all.
    """
    short: list[tuple[int, list[str]]] = []

    def together() -> Iterator[tuple[int, np.ndarray]]:
        numbers = chunks.of(list(chain.from_iterable(own for _, own in short)))
        chunks.uses += np.bincount(numbers, minlength=len(chunks.uses))
        stops = np.cumsum([len(own) for _, own in short])[:-1]
        for (place, _), own in zip(short, np.split(numbers, stops), strict=True):
            if chunks.numbers[3][own].all():
                yield place, own
        short.clear()

    held = 0
    for place, text in enumerate(texts):
        if text and len(text) < BLOCK:
            short.append((place, next(words.chunks(text))))
            held += len(text)
        if short and (held >= TOGETHER or place == len(texts) - 1 or len(text or "") >= BLOCK):
            yield from together()
            held = 0
        if text and len(text) >= BLOCK:
            if all(map(chunks.spelled, words.chunks(text))):
                yield from ((place, chunks.of(block)) for block in words.chunks(text))


def of_worker(a_path: str, b_path: str) -> tuple[Vocabularies, Chunks]:
    """The tokenizers and the chunks that a Python worker has met in any task."""

    def build() -> tuple[Vocabularies, Chunks]:
        words = Vocabularies(a_path, b_path)
        return words, Chunks(words)

    return per_worker(("cross_tokenizer", (a_path, b_path)), build)


def linked_pairs(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """keys and counts: one row per task with the pairs that its texts link and how often they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunks = of_worker(a_path, b_path)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                met = [n for _, n in spelled_texts(words, chunks, part.column("text").to_pylist())]
                times = np.bincount(np.concatenate([np.zeros(0, np.int64), *met]), minlength=len(chunks.uses))
                more = np.repeat(times, chunks.numbers[2])
                keys, owner = np.unique(np.concatenate([keys, chunks.links[more > 0]]), return_inverse=True)
                summed = np.zeros(len(keys), np.int64)
                np.add.at(summed, owner, np.concatenate([counts, more[more > 0]]))
                counts = summed
                chunks.forget()
        arrays = [pa.array([x], pa.list_(pa.int64())) for x in (keys, counts)]
        yield pa.RecordBatch.from_arrays(arrays, ["keys", "counts"])

    return rows.mapInArrow(run, "keys array<bigint>, counts array<bigint>")


def tree_sum(pairs: DataFrame, table: PerfectHash) -> np.ndarray:
    """The number of every pair by its index, summed over all rows of ``linked_pairs``.

    A task of the first level adds the rows of several tasks into one dense vector. The second level
    adds these vectors block by block. Only the sum, one number per pair, reaches the driver.
    """
    size = len(table.keys)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                total[table.indices(keys.values.to_numpy())] += counts.values.to_numpy()
        starts = range(0, size, SLICE) if total.any() else ()
        blocks = [total[s : s + SLICE].tobytes() for s in starts]
        arrays = [pa.array([s // SLICE for s in starts], pa.int64()), pa.array(blocks, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                more = np.frombuffer(counts.as_buffer(), np.int64)
                total[block] = total[block] + more if block in total else more
        arrays = [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["block", "counts"])

    tasks = pairs.rdd.getNumPartitions()
    schema = "block bigint, counts binary"
    first = pairs.repartition(max(1, math.isqrt(tasks)), "task").mapInArrow(dense, schema)
    blocks = max(1, math.ceil(size / SLICE))
    second = first.repartition(blocks, "block").mapInArrow(added, schema)
    counts = np.zeros(size, np.int64)
    for row in second.collect():
        start = row["block"] * SLICE
        counts[start : start + SLICE] = np.frombuffer(row["counts"], np.int64)
    return counts


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> tuple[PerfectHash, np.ndarray]:
    """The hash of the distinct linked pairs of a corpus (column text), and their counts by index."""
    met = linked_pairs(rows, a_path, b_path).withColumn("task", F.spark_partition_id())
    met = checkpointed(met)
    # At most ``most_pairs`` numbers, whatever the corpus.
    distinct = met.select(F.explode("keys").alias("key")).distinct().toPandas()["key"]
    table = PerfectHash(np.sort(distinct.to_numpy(np.int64)))
    return table, tree_sum(met, table)


def align_tokenizers(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and the alignment of every row: tokens of A and B, groups, links and their counts.

    A reads a space and the text, B the text, to which it adds the space; special strings in texts are
    plain text. ``n_best`` counts the links whose pair is the most frequent of its B id in the corpus,
    ties included, ``count_sum`` adds the pairs' counts over the links, and ``groups_sha256`` is the
    digest of the groups as text. NULL and empty texts, and texts that either tokenizer doesn't spell
    byte by byte, have no tokens: zeros and ''. Rows that repeat count each time. An empty table
    gives no rows. Other columns are ignored, whatever their names. The files of the tokenizers lie
    at the same place on every executor.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    table, counts = pair_counts(rows.select("text"), a_path, b_path)
    best = np.zeros(int((table.keys & 0xFFFFFFFF).max(initial=-1)) + 1, np.int64)
    np.maximum.at(best, table.keys & 0xFFFFFFFF, counts)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words, chunks = of_worker(a_path, b_path)
        worth = np.zeros((2, 0), np.int64)  # per chunk: links that are their B id's best, and their counts

        def aligned(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal worth
            if len(chunks.index) > chunks.known:
                chunks.forget()
                worth = worth[:, :0]
            sums = np.zeros((6, part.num_rows), np.int64)
            digests: dict[int, hashlib._Hash] = {}
            for place, numbers in spelled_texts(words, chunks, part.column("text").to_pylist()):
                if worth.shape[1] < len(chunks.uses):
                    worth = _worth(chunks, worth)
                n_a, n_b, links = chunks.numbers[:3, numbers].sum(axis=1).tolist()
                sums[:, place] += [n_a, n_b, links, links, *worth[:, numbers].sum(axis=1).tolist()]
                groups = "".join(map(chunks.texts.__getitem__, numbers.tolist()))[:-1]
                digest = digests.get(place)
                if digest is None:
                    digests[place] = hashlib.sha256(groups.encode())
                elif groups:
                    digest.update(f";{groups}".encode())
            shown = [digests[i].hexdigest() if i in digests else "" for i in range(part.num_rows)]
            arrays = [part.column("doc_id"), *map(pa.array, sums), pa.array(shown, pa.string())]
            names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
            return pa.RecordBatch.from_arrays(arrays, names)

        return aligned

    def _worth(chunks: Chunks, known: np.ndarray) -> np.ndarray:
        done = known.shape[1]
        links = chunks.numbers[2, done:]
        keys = chunks.links[len(chunks.links) - int(links.sum()) :]
        index = table.indices(keys)
        there = index >= 0  # but for chunks of texts that aren't spelled, or of another corpus
        own, owner = counts[index[there]], np.repeat(np.arange(len(links)), links)[there]
        sums = np.zeros((2, len(links)), np.int64)
        np.add.at(sums[0], owner, own == best[keys[there] & 0xFFFFFFFF])
        np.add.at(sums[1], owner, own)
        return np.concatenate([known, sums], axis=1)

    return map_text(rows, work, f"doc_id {kind}, {SCHEMA}")
