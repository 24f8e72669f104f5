"""Language of texts by a linear-chain conditional random field over words.

Every word has a language. Its features are its affixes and letter trigrams, and the whole word where
the training texts know it; the transitions are learned, so a word that tells little takes its
language from its neighbours, and a text may switch. Forward-backward gives each word the
probabilities of its languages; a text's language is the one with the highest mean over its words.

The chain runs over the whole text. For speed all stretches of ``STRETCH`` words of all texts of a
batch are worked on in step: first what each stretch makes of any state before it, a small matrix,
then the messages from stretch to stretch, forward and backward, and last the words inside. This is
the plain chain's result.

The field is trained on a bounded sample of labelled texts. A text's language is taken as that of all
its words, and half of the sequences are joined from texts of two languages, so that switches occur.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import map_text
from bylines.llm.crf import maximise

SAMPLE = 4_000  # labelled texts that the field is trained on, as many of each language
PER_LANGUAGE = 1_000  # at most; up to here Spark picks a group's first rows before it shuffles
PIECE = 24  # words of a text in a training sequence, from its middle
OFTEN = 3  # times a feature must occur in the training sequences to have a weight
EPOCHS = 40
STRETCH = 64  # words of a text that are worked on in step
TOGETHER = 4_000_000  # numbers in the matrices of stretches that are made at a time
KNOWN = 300_000  # words whose scores a task remembers
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")
SIGNS = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "0123456789«»„“”’…¿¡"


def word_features(word: str) -> list[str]:
    """The word between boundaries, its affixes and its trigrams; nothing for words without letters."""
    inner = word.lower().strip(SIGNS)
    if not inner:
        return []
    whole = f"^{inner}$"
    return [whole, whole[:2], whole[:4], whole[-2:], whole[-4:], *(whole[i : i + 3] for i in range(len(whole) - 2))]


@dataclass
class Field:
    """Languages, feature numbers, weights by feature and language, and transitions."""

    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray


def train(texts: list[tuple[str, str]]) -> Field | None:
    """A field from (text, language); None if there is nothing to learn."""
    rng = random.Random(11)
    pieces = []
    for text, language in texts:
        words = text.split()
        start = max(0, (len(words) - PIECE) // 2)
        if words:
            pieces.append((words[start : start + PIECE], language))
    if not pieces:
        return None
    languages = sorted({language for _, language in pieces})
    others = rng.sample(pieces, len(pieces))
    sequences = [
        [one, other] if i % 2 and one[1] != other[1] else [one]
        for i, (one, other) in enumerate(zip(pieces, others, strict=True))
    ]
    words, gold, first = [], [], []
    for sequence in sequences:
        begin = len(words)
        for piece, own in sequence:
            words += piece
            gold += [languages.index(own)] * len(piece)
        first += [i == begin for i in range(begin, len(words))]
    features = [word_features(w) for w in words]
    often = sorted(f for f, n in Counter(chain.from_iterable(features)).items() if n >= OFTEN)
    index = {f: i for i, f in enumerate(often)}
    pairs = [(row, index[f]) for row, own in enumerate(features) for f in own if f in index]
    rows, columns = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    weights, moves = maximise(rows, columns, np.array(gold), np.array(first), len(index), len(languages), EPOCHS)
    return Field(languages, index, weights, moves)


def fit(
    docs: DataFrame,
    learnable: str = "true",
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
) -> Field | None:
    """A field from at most ``sample`` rows with text and language for which ``learnable`` (SQL on doc_id) holds.

    Each language has the same number of them, or all that it has; of equal texts with the same
    language one counts. They are chosen by a hash of the text, so a rare language is learnt as well.
    """
    rows = docs.selectExpr(
        f"`{id_col}` AS doc_id", f"`{text_col}` AS text", f"`{lang_col}` AS lang", f"xxhash64(`{text_col}`, 5) AS order"
    )
    rows = rows.filter(f"doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND ({learnable})")
    apart = rows.groupBy("lang", "order").agg(F.min("doc_id").alias("doc_id"))
    spoken = rows.select("lang").distinct().count()
    each = min(PER_LANGUAGE, max(1, sample // max(1, spoken)))
    first = F.expr("row_number() OVER (PARTITION BY lang ORDER BY order, doc_id)")
    chosen = apart.withColumn("_first", first).filter(f"_first <= {each}").drop("_first")
    # About ``sample`` rows, of which only the words that training uses come to the driver.
    words = r"split(regexp_replace(text, '\\s+', ' '), ' ')"
    middle = f"slice(w, greatest(1, (size(w) - {PIECE}) DIV 2), {PIECE + 2})"
    taken = rows.join(F.broadcast(chosen), ["doc_id", "lang", "order"]).selectExpr("order", "lang", f"{words} AS w")
    found = taken.selectExpr("order", "lang", f"array_join({middle}, ' ') AS piece").distinct().collect()
    return train([(r["piece"], r["lang"]) for r in sorted(found, key=lambda r: (r["order"], r["lang"], r["piece"]))])


def tagger(field: Field) -> Callable[[list[str]], list[tuple[str, float, int]]]:
    """A function from texts to their language, its mean probability, and the number of switches between words."""
    size = len(field.languages)
    between = np.exp(field.moves[:-1] - field.moves[:-1].max())
    begin = np.exp(field.moves[-1] - field.moves[-1].max())
    memory: dict[str, int] = {}
    state = {"table": np.zeros((0, size)), "letters": np.zeros(0, bool)}

    def learn(words: list[str]) -> None:
        get = field.index.get
        own = [[i for f in word_features(w) if (i := get(f)) is not None] for w in words]
        counts = np.fromiter(map(len, own), np.int64, len(own))
        columns = np.fromiter(chain.from_iterable(own), np.int64, int(counts.sum()))
        table = np.zeros((len(words), size))
        full = counts > 0
        if full.any():
            table[full] = np.add.reduceat(field.weights[columns], (np.cumsum(counts) - counts)[full], axis=0)
        letters = np.fromiter((bool(LETTER.search(w)) for w in words), bool, len(words))
        state["table"] = np.concatenate([state["table"], table])
        state["letters"] = np.concatenate([state["letters"], letters])
        memory.update(zip(words, range(len(memory), len(memory) + len(words)), strict=True))

    def posteriors(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probabilities of the languages of each word, given the text's whole chain."""
        score = state["table"][ids]
        local = np.exp(score - score.max(axis=1, keepdims=True))
        place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.flatnonzero(place % STRETCH == 0)
        number = place[starts] // STRETCH  # of the stretch in its text
        lengths = np.diff(np.append(starts, len(ids)))
        last = np.append(number[1:] == 0, True)[: len(starts)]
        through = matrices(local, starts, lengths, number > 0)
        before, after = messages(local, starts, lengths, number, last, through)

        order = np.argsort(-lengths, kind="stable")
        starts, lengths, before, after = starts[order], lengths[order], before[order], after[order]
        live = [int(np.searchsorted(-lengths, -k, side="right")) for k in range(1, STRETCH + 1)]
        ahead, behind = np.empty_like(local), np.empty_like(local)
        behind[starts + lengths - 1] = after
        now = before * local[starts]
        ahead[starts] = now = now / now.sum(axis=1, keepdims=True)
        for k in range(1, STRETCH):
            at = starts[: live[k]] + k
            if not len(at):
                break
            now = (now[: len(at)] @ between) * local[at]
            ahead[at] = now = now / now.sum(axis=1, keepdims=True)
        for k in range(STRETCH - 1, 0, -1):
            at = starts[: live[k]] + k
            if len(at):
                back = (local[at] * behind[at]) @ between.T
                behind[at - 1] = back / back.sum(axis=1, keepdims=True)
        both = ahead * behind
        return both / both.sum(axis=1, keepdims=True)

    def matrices(local: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each wanted stretch, what leads from the state before it to that of its last word, up to a factor."""
        found = np.zeros((len(starts), size, size) if wanted.any() else (0, size, size))
        chosen = np.flatnonzero(wanted)
        step = max(1, TOGETHER // size**2)
        for part in (chosen[i : i + step] for i in range(0, len(chosen), step)):
            part = part[np.argsort(-lengths[part], kind="stable")]
            now = np.tile(np.eye(size), (len(part), 1, 1))
            for k in range(int(lengths[part[0]])):
                live = int(np.searchsorted(-lengths[part], -(k + 1), side="right"))
                own = (now[:live] @ between) * local[starts[part[:live]] + k][:, None, :]
                now[:live] = own / own.sum(axis=(1, 2), keepdims=True)
            found[part] = now
        return found

    def messages(
        local: np.ndarray,
        starts: np.ndarray,
        lengths: np.ndarray,
        number: np.ndarray,
        last: np.ndarray,
        through: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Per stretch: weights of its first word's languages from before it, and of its last word's from behind."""
        before, after = np.tile(begin, (len(starts), 1)), np.ones((len(starts), size))
        stretches = np.arange(len(starts))
        first = stretches[(number == 0) & ~last]
        if not len(first):
            return before, after
        # The state of the last word of the first stretch of texts with several, all in step.
        now = begin * local[starts[first]]
        for k in range(1, STRETCH):
            now = now / now.sum(axis=1, keepdims=True)
            now = (now @ between) * local[starts[first] + k]
        sizes = np.diff(np.append(stretches[number == 0], len(starts)))[~last[number == 0]]
        order = np.argsort(-sizes, kind="stable")
        first, sizes, now = first[order], sizes[order], now[order]
        for k in range(1, int(sizes[0])):
            live = int(np.searchsorted(-sizes, -(k + 1), side="right"))
            now = now[:live] / now[:live].sum(axis=1, keepdims=True)
            at = first[:live] + k
            before[at] = now @ between
            now = (now[:, None, :] @ through[at])[:, 0, :]
        for k in range(int(sizes[0]) - 1, 0, -1):
            at = first[: int(np.searchsorted(-sizes, -(k + 1), side="right"))] + k
            back = (through[at] @ after[at][:, :, None])[:, :, 0]
            after[at - 1] = back / back.sum(axis=1, keepdims=True)
        return before, after

    def tag(texts: list[str]) -> list[tuple[str, float, int]]:
        if len(memory) > KNOWN:
            memory.clear()
            state["table"], state["letters"] = state["table"][:0], state["letters"][:0]
        cut = [t.split() for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(memory))
        if new:
            learn(new)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        ids = np.fromiter(map(memory.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        found: list[tuple[str, float, int]] = [(UNKNOWN, 0.0, 0)] * len(texts)
        if not len(ids):
            return found
        keep = state["letters"][ids]
        owner = np.repeat(np.arange(len(cut)), counts)[keep]
        chance = posteriors(ids, counts)[keep]
        if not len(owner):
            return found
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        ends = np.append(begins[1:], len(owner))
        mean = np.add.reduceat(chance, begins, axis=0) / (ends - begins)[:, None]
        tags = chance.argmax(axis=1)
        change = np.append(0, (tags[1:] != tags[:-1]) & (owner[1:] == owner[:-1]))
        switches = np.add.reduceat(change, begins)
        best = mean.argmax(axis=1)
        for i, doc in enumerate(owner[begins].tolist()):
            found[doc] = (field.languages[best[i]], min(1.0, float(mean[i, best[i]])), int(switches[i]))
        return found

    return tag


def identify(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and n_switches (changes of language between words) of every row.

    NULL texts and texts without a letter are ``und`` with score 0, as is every text if there was
    nothing to learn from. Of languages with equal means the first in order is taken. Repeated rows
    have the same result. Other columns are ignored.
    """

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        tag = tagger(field) if field else lambda texts: [(UNKNOWN, 0.0, 0)] * len(texts)

        def name(part: pa.RecordBatch) -> pa.RecordBatch:
            found = tag([t or "" for t in part.column("text").to_pylist()])
            types = (pa.string(), pa.float64(), pa.int64())
            arrays = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            names = ["doc_id", "lang_pred", "score", "n_switches"]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names)

        return name

    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return map_text(rows, work, f"doc_id {kind}, lang_pred string, score double, n_switches bigint")
