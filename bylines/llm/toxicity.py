"""Toxicity of texts after noisy-channel deobfuscation.

The channel turns letters into look-alikes, repeats them, or puts separators or spaces between them.
A token with signs, digits or doubled letters spans a lattice: every character may stand for itself, for
letters it resembles, or for nothing; a run may stand for one or two letters. A Viterbi search finds the
reading that is cheapest under the channel and a character language model. Signs around a token that look
like letters are read with it, without it, or as the search decides; the reading with most evidence counts.
Runs of short tokens, with the token before and behind, are one lattice: a space may be the end of a word
or a separator like others. A search that can't end in a word or prefix with evidence is left out.
The model counts letter 4-grams over all documents, so what it gathers grows with the corpus, and its
table has a fixed size.

Scores come from the restored words. A feature (a word, or its first four to seven letters) has the
smoothed share of toxic texts among the labelled texts that hold it, counted once per family of near
copies. A logistic regression weighs the three highest shares among a text's words and the number of
its words. It is fitted on shares that the other half of the families gave, so that rare words are
not taken for better evidence than they are. A feature whose share is at least ``DECISIVE`` even at
the lower end of a wide confidence interval decides alone: one such word in a long text is enough.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import compress, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import map_text, per_worker, text_slices, texts

SAMPLE = 20_000  # most labelled rows that the shares are fitted on
PRIOR = 4.0  # texts that the base rate counts as
LEAST = 0.25  # share from which a feature is kept; lower ones count as the base rate
SUPPORT = 3  # toxic families that must hold a feature
DECISIVE = 0.9  # lower bound of a share that decides alone
WIDTH = 3.0  # standard deviations to that bound
BEST = 3  # words of a text that count
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7
SHORT = 3  # most characters of a token that may be a part of a word
ANY = float("inf")  # share of what may decide alone
KNOWN = 200_000  # tokens whose evidence a worker remembers
TOGETHER = 1 << 20  # characters of texts whose tokens are looked at together
OPENED = 200_000  # tokens whose features a worker remembers
PIECE = 1 << 20  # letters that are counted at a time

# What a character may stand for besides itself.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "*": "aeiou", "#": "h",
    "€": "e", "£": "l", "¥": "y", "¢": "c", "§": "s", "µ": "u", "¡": "i",
}
SEPARATORS = ".-_*~'·"  # characters that may stand for nothing inside a word
LOOK, REPEAT, NOTHING = 1.5, 0.5, 1.0  # costs, in nats

# Signs that no reading keeps at either end of a token.
AROUND = '.,;:?"'
ALIKE = "".join(c for c in LOOKS if not c.isalnum())

LONG_RUN = re.compile(r"(.)\1{3,}")
DOUBLED = re.compile(r"(.)\1")
DOUBLED_ALL = re.compile(r"(.)\1+")
BRANCHING = re.compile(r"(.)\1+|[^a-zß-öø-ÿœ]", re.DOTALL)  # what more than one way leads through; other letters don't matter
NO_LETTER = re.compile(r"[^\w\n]|[\d_]")
SIGN = re.compile(f"[{re.escape(ALIKE)}]")
START = 4  # letters of a skeleton that mostly tell whether it begins with a known prefix
LONG = 64  # letters of a segment that is remembered
SAME = str.maketrans(
    dict.fromkeys("\"%&'),-./:;=>?[\\]^_`}~")  # signs that stand for nothing in a skeleton
    | {"l": "i"}
    | {c: letters[0].replace("l", "i") for c, letters in LOOKS.items()}
)
LETTERS = 28  # boundary, a to z, any other letter
ORDER = 4
CONTEXTS = LETTERS ** (ORDER - 1)

Segment = tuple[tuple[int, ...], float, int | None]  # first classes, cost of the others, and the last three classes
Arc = tuple[int, str, tuple[int, ...], float]  # characters taken, letters they stand for, their classes, cost


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the collector of cycles: none arise here, and it would go through all that a worker remembers time and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def letter_classes() -> np.ndarray:
    """Class of each byte: 0 between words, 1 to 26 for letters in either case, 27 beyond ASCII."""
    classes = np.zeros(256, np.uint8)
    for i in range(26):
        classes[[65 + i, 97 + i]] = i + 1
    classes[128:] = LETTERS - 1
    return classes


def gram_counts(classes: np.ndarray) -> np.ndarray:
    """Counts of the 4-grams that end in each class, each word by itself between boundaries.

    Works on a piece at a time, so that memory doesn't follow the size of the text.
    """
    total = np.zeros(LETTERS**ORDER, np.int64)
    before, behind_letter = np.zeros(ORDER - 1, np.int32), True
    for start in range(0, len(classes), PIECE):
        piece = classes[start : start + PIECE].astype(np.int32)
        inside = piece > 0
        piece = piece[inside | np.append(behind_letter, inside[:-1])]
        apart = np.concatenate([before, np.repeat(piece, np.where(piece > 0, 1, ORDER - 1))])
        total += _gram_numbers(apart)
        before, behind_letter = apart[1 - ORDER :], bool(inside[-1])
    return total + _gram_numbers(np.append(before, 0))


def _gram_numbers(apart: np.ndarray) -> np.ndarray:
    index = apart[3:] + LETTERS * (apart[2:-1] + LETTERS * (apart[1:-2] + LETTERS * apart[:-3]))
    return np.bincount(index, minlength=LETTERS**ORDER)


def count_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram and n over all texts; at most 28^4 rows, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = letter_classes(), np.zeros(LETTERS**ORDER, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                joined = b" ".join(texts(part))
                total += gram_counts(table[np.frombuffer(joined, np.uint8)])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["gram", "n"])

    counted = docs.selectExpr(f"`{text_col}` AS text").mapInArrow(run, "gram bigint, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def letter_costs(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cost in nats of a letter behind three others, backing off to shorter contexts."""
    full = np.zeros(LETTERS**ORDER)
    full[grams] = counts
    full = full.reshape([LETTERS] * ORDER)
    chance = np.full(LETTERS, 1 / LETTERS)
    for missing in range(ORDER - 1, -1, -1):
        seen = full.sum(axis=tuple(range(missing))) if missing else full
        chance = (seen + 5 * chance) / (seen.sum(axis=-1, keepdims=True) + 5)
    return -np.log(chance).astype(np.float32)


def suspicious(token: str) -> bool:
    """Whether a stripped token can be read in another way: it has signs or digits, or equal letters in a row."""
    if token.isalpha():
        return bool(DOUBLED.search(token))
    return any(c.isalpha() or c in LOOKS for c in token)


def stripped(token: str, looks: str = "@$€£", behind: str = "") -> str:
    """A token without the signs around it, but for ``looks`` in front and ``behind`` at the end."""
    start, end = 0, len(token)
    while end > start and not token[end - 1].isalnum() and token[end - 1] not in behind:
        end -= 1
    while start < end and not token[start].isalnum() and token[start] not in looks:
        start += 1
    return token[start:end]


def readings(token: str) -> list[str]:
    """A token without the signs around it, and with those of them that look like letters in front, behind or both."""
    if token.isalnum():
        return [token]
    sides = (("", ""), (ALIKE, ""), ("", ALIKE), (ALIKE, ALIKE))
    return list(dict.fromkeys(stripped(token, front, behind) for front, behind in sides))


@dataclass
class Model:
    """Letter costs, features and weights; of fixed size, or bounded by the sample."""

    costs: np.ndarray
    shares: dict[str, float]
    base: float
    sure: dict[str, float]
    weights: np.ndarray | None = None
    key: tuple[str, str] = field(default_factory=lambda: (uuid.uuid4().hex, ""))  # of what a worker remembers

    def __post_init__(self) -> None:
        self._flat: list[float] = []
        self._summary: Summary | None = None
        self._arcs: dict[tuple[str, int, bool], list[Arc]] = {}
        self._segments: dict[str, Segment] = {}
        self._begins = {f[:-1]: share for f, share in self.shares.items() if f.endswith("*")}
        self._heads = {begin[: PREFIXES[0]] for begin in self._begins}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_flat": [], "_summary": None, "_arcs": {}, "_segments": {}}

    def segment(self, letters: str) -> Segment:
        """What letters with one way through them cost behind their first three, whatever is in front."""
        found = self._segments.get(letters)
        if found is None:
            symbols = tuple(map(_class, letters))
            here, tail = 0, 0.0
            for at, symbol in enumerate(symbols):
                here = here * LETTERS + symbol
                if at >= ORDER - 1:
                    tail += self._flat[here]
                here %= CONTEXTS
            found = symbols[: ORDER - 1], tail, here if len(symbols) >= ORDER - 1 else None
            if len(self._segments) > KNOWN:
                self._segments.clear()
            if len(letters) <= LONG:
                self._segments[letters] = found
        return found

    def arcs(self, token: str, at: int) -> list[Arc]:
        """Ways on from a place."""
        char = token[at]
        run = 3 if token[at : at + 3] == char * 3 else 2 if token[at : at + 2] == char * 2 else 1
        own = char, run, at == 0 or token[at - 1] != char
        if own not in self._arcs:
            if len(self._arcs) > KNOWN:
                self._arcs.clear()
            self._arcs[own] = [(n, letters, tuple(map(_class, letters)), price) for n, letters, price in _arcs(*own)]
        return self._arcs[own]

    def restore(self, token: str, loose: bool = False) -> str:
        """The cheapest reading of a stripped, lower-case token or run; of equally cheap ones the first found.

        Runs of more than three equal characters count as three. Time and memory grow with the length.
        If ``loose``, signs around the token may stand for nothing.
        """
        token = LONG_RUN.sub(r"\1\1\1", token)
        if not self._flat:
            self._flat = self.costs.ravel().tolist()
        flat, size = self._flat, len(token)
        # At each place: the last three classes, as one number, to the cost and the letters so far, linked backwards.
        states: dict[int, dict] = {0: {0: (0.0, None)}}
        bare = [at for at, c in enumerate(token) if c.isalnum()] or [size] if loose else []
        done = 0
        for match in [*BRANCHING.finditer(token), None]:
            start, end = match.span() if match else (size, size)
            if start > done:
                self._pass(states, token[done:start], done)
            for at in range(start, end):
                if token[at] == " " and not loose:
                    self._space(states, at)
                    continue
                arcs = self.arcs(token, at)
                if loose and not bare[0] <= at <= bare[-1]:
                    arcs = [*arcs, (1, "", (), NOTHING)]
                for context, (cost, path) in states.pop(at, {}).items():
                    for taken, letters, symbols, price in arcs:
                        here, total = context, cost + price
                        for symbol in symbols:
                            here = here * LETTERS + symbol
                            total += flat[here]
                            here = here % CONTEXTS if symbol else 0
                        onward = states.setdefault(at + taken, {})
                        old = onward.get(here)
                        if old is None or total < old[0]:
                            onward[here] = (total, (path, letters))
            done = end
        if not states.get(size):
            return token
        _, path = min(
            ((cost + flat[context * LETTERS], path) for context, (cost, path) in states[size].items()),
            key=lambda end: end[0],
        )
        parts = []
        while path:
            path, letters = path
            parts.append(letters)
        return "".join(reversed(parts))

    def _space(self, states: dict[int, dict], at: int) -> None:
        """A space ends a word, or stands for nothing."""
        flat, onward = self._flat, states.setdefault(at + 1, {})
        for context, (cost, path) in states.pop(at, {}).items():
            end = cost + flat[context * LETTERS]
            old = onward.get(0)
            if old is None or end < old[0]:
                onward[0] = (end, (path, " "))
            cost += NOTHING
            old = onward.get(context)
            if old is None or cost < old[0]:
                onward[context] = (cost, (path, ""))

    def _pass(self, states: dict[int, dict], letters: str, at: int) -> None:
        """Take all states at a place through letters that can only stand for themselves."""
        flat, onward = self._flat, states.setdefault(at + len(letters), {})
        first, tail, end = self.segment(letters)
        for context, (cost, path) in states.pop(at, {}).items():
            for symbol in first:
                context = context * LETTERS + symbol
                cost += flat[context]
                context %= CONTEXTS
            cost += tail
            if end is not None:
                context = end
            old = onward.get(context)
            if old is None or cost < old[0]:
                onward[context] = (cost, (path, letters))

    def features(self, token: str) -> list[str]:
        """Distinct features of the words that a raw lower-case token may stand for."""
        return list(dict.fromkeys(f for word in self.words(token) for f in word_features(word)))

    def words(self, token: str, known: Known | None = None) -> list[str]:
        """What a raw lower-case token may stand for: its readings, restored, and itself if it is all letters.

        Without readings that can't have evidence, if ``known`` is given.
        """
        found = []
        for word in readings(token):
            if suspicious(word) and (known is None or known.may_be(word)):
                found.append(self.restore(word))
            if not suspicious(word) or word.isalpha():
                found.append(word)
        signs = len(word) - len(word.strip(ALIKE))  # the last reading has all signs
        if signs > 1 and any(map(str.isalnum, word)) and (known is None or known.may_begin(word)):
            found.append(self.restore(word, loose=True))
        return list(dict.fromkeys(found))

    def joined(self, run: str) -> list[str]:
        """Words of a run of tokens that are not tokens of it."""
        tokens = set(run.split())
        return [w for w in dict.fromkeys(self.restore(run).split()) if w not in tokens]

    def weigh(self, words: list[str]) -> tuple[float, float, str] | None:
        """Of the word with most evidence: the highest share among its features, its bound if that decides, the word.

        None if no feature's share exceeds the base rate.
        """
        best, shares, begins, heads = None, self.shares, self._begins, self._heads
        for word in words:
            if not word or word not in shares and word[: PREFIXES[0]] not in heads:
                continue
            share = shares.get(word, 0.0)
            for n in PREFIXES:
                if n > len(word):
                    break
                share = max(share, begins.get(word[:n], 0.0))
            if share > self.base:
                own = share, max(self.sure.get(f, 0.0) for f in word_features(word)), word
                best = max(best or own, own, key=lambda e: (e[1], e[0]))
        return best

    def evidence(self, token: str, known: Known | None = None) -> tuple[float, float, str] | None:
        """What the words weigh that a token may stand for."""
        return self.weigh(self.words(token, known))

    def summary(self) -> Summary:
        return Summary(self)

    def scores(self, texts: list[str]) -> list[float]:
        """The score of each text."""
        if self.weights is None:
            return [self.base] * len(texts)
        self._summary = self._summary or Summary(self)
        found = self._summary.of(texts)
        return [max(sure, float(1 / (1 + np.exp(-np.dot(self.weights, x))))) for x, sure in found]

    def scorer(self) -> Callable[[str], float]:
        return lambda text: self.scores([text])[0]


# Evidence of a token, the highest share that a word beginning with it may have (0 if none), its skeleton.
Look = tuple[tuple[float, float, str] | None, float, str]


class Summary:
    """What the regression weighs of texts. Tokens are looked at once per worker, those of many texts together."""

    def __init__(self, model: Model):
        self.model, self.known = model, Known(model.shares, model.base, model.sure)
        number, name = model.key
        # Of all tokens, and of those that a score may come from: few, so that a text's other tokens cost a glance.
        self.memory: dict[str, Look]
        self.notable: dict[str, Look]
        self.memory, self.notable = per_worker(("toxicity", number), dict).setdefault(name, ({}, {}))

    def of(self, texts: list[str]) -> list[tuple[list[float], float]]:
        """What the regression weighs, and the highest bound that decides alone or 0, of each text."""
        found, held, size = [], [], 0
        with uncollected():
            for text in texts:
                held.append(text.lower().split())
                size += len(text)
                if size >= TOGETHER:
                    found += self._together(held)
                    held, size = [], 0
            return found + self._together(held)

    def _together(self, cut: list[list[str]]) -> list[tuple[list[float], float]]:
        if len(self.memory) > KNOWN:
            newer = dict(islice(self.memory.items(), len(self.memory) // 2, None))
            self.memory.clear()
            self.memory.update(newer)
            for token in [t for t in self.notable if t not in newer]:
                del self.notable[token]
        tokens = list(map(set, cut))
        self._learn(list(set().union(*tokens).difference(self.memory)))
        return list(map(self._one, cut, tokens))

    def _learn(self, tokens: list[str]) -> None:
        """Look at new tokens; signs around a token that stand for nothing make no difference."""
        memory, notable, model, known = self.memory, self.notable, self.model, self.known
        shares, heads = model.shares, model._heads
        begun, beginnings, beginning = known.begun, known._beginnings, known.beginning
        inner = [token.strip(AROUND) for token in tokens]
        new = list(set(inner).difference(memory))
        for token, bones in zip(new, skeletons(new), strict=True):
            if token.isalpha() and bones not in begun and (beginnings.get(bones[:START]) or beginning(bones))[0] < 0:
                memory[token] = None, 0.0, token if bones == token else bones
                continue
            reach = known.reach(bones)
            if not known.may_have(token, bones):
                evidence, reach = None, ANY if "*" in token else reach
            elif "*" in token:
                evidence, reach = model.evidence(token, known), ANY
            elif not token.isalpha():
                # The only reading of a token between letters or digits is the token.
                if token and token[0].isalnum() and token[-1].isalnum() and suspicious(token):
                    evidence = model.weigh([model.restore(token)]) if known.holds(bones) else None
                else:
                    evidence = model.evidence(token, known)
            elif DOUBLED.search(token):
                evidence = model.weigh([model.restore(token), token] if known.holds(bones) else [token])
            elif token in shares or token[: PREFIXES[0]] in heads:
                evidence = model.weigh([token])
            else:
                evidence = None
            memory[token] = evidence, reach, token if bones == token else bones
            if evidence or reach:
                notable[token] = memory[token]
        for token, own in zip(tokens, inner, strict=True):
            if token != own:
                memory[token] = memory[own]
                if own in notable:
                    notable[token] = memory[own]

    def _one(self, words: list[str], tokens: set[str]) -> tuple[list[float], float]:
        model, memory, notable = self.model, self.memory, self.notable
        looks = {token: notable[token] for token in filter(notable.__contains__, tokens)}
        found = {look[0] for look in looks.values()}
        # A joined word changes nothing if BEST words have as much evidence, unless it may decide alone.
        enough = max(sorted((e[0] for e in found if e), reverse=True)[BEST - 1 : BEST], default=0.0)
        opening = {token for token, look in looks.items() if look[1] > enough}
        if self.known.longest and opening:
            for run in runs_at(words, self.known.joined(words, opening, memory, enough)):
                found.update(model.weigh([word]) for word in model.joined(run))
        found.discard(None)
        shares = sorted((share for share, _, _ in found), reverse=True)[:BEST]
        odds = [_logit(s) for s in [*shares, *[model.base] * (BEST - len(shares))]]
        return [*odds, float(np.log1p(len(tokens))), 1.0], max((sure for _, sure, _ in found), default=0.0)


def _logit(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column is the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _class(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter == " " else LETTERS - 1


def _arcs(char: str, run: int, first: bool) -> list[tuple[int, str, float]]:
    """Ways on from a character that begins a run of so many: characters taken, letters they stand for, cost."""
    arcs = []
    if char == " ":
        return [(1, " ", 0.0), (1, "", NOTHING)]
    readings = [(char, 0.0)] if char.isalpha() else []
    readings += [(letter, LOOK) for letter in LOOKS.get(char, "")]
    for letter, price in readings:
        arcs.append((1, letter, price))
        if first and run > 1:
            arcs.append((run, letter, price + REPEAT))
        if first and run == 2 and price:
            arcs.append((run, letter * 2, price))  # one habit of writing, seen twice
        if first and run > 2:
            arcs.append((run, letter * 2, price + REPEAT))
    if char in SEPARATORS or not readings:
        arcs.append((1, "", NOTHING))
    return arcs


def stretch(words: list[str], at: int) -> tuple[int, int]:
    """Where the run of short tokens begins and ends that holds a place or follows it, with its neighbours."""
    start = end = at + (len(words[at]) > SHORT)
    while start > 0 and len(words[start - 1]) <= SHORT:
        start -= 1
    while end < len(words) and len(words[end]) <= SHORT:
        end += 1
    return max(0, start - 1), min(len(words), end + 1)


def spaced(words: list[str]) -> Iterator[int]:
    """Places of the first of three or more single characters in a row."""
    alone = [len(w) == 1 or (len(w) == 2 and not w[1].isalnum()) for w in words]
    for at in range(len(words) - 2):
        if alone[at] and alone[at + 1] and alone[at + 2] and not (at and alone[at - 1]):
            yield at


def runs_at(words: list[str], places: Iterator[int]) -> Iterator[str]:
    """The runs around some places in ascending order, each once."""
    done = -1
    for at in places:
        if at >= done:
            start, end = stretch(words, at)
            yield " ".join(words[start:end])
            done = max(at + 1, end - 1)  # the neighbour behind may begin the next run


def skeleton(token: str) -> str:
    """What all readings of a token without * have in common: look-alikes as one letter, runs as one."""
    bones = token.translate(SAME)
    if not bones.isalpha():
        bones = "".join(filter(str.isalpha, bones))
    return DOUBLED_ALL.sub(r"\1", bones) if DOUBLED.search(bones) else bones


def skeletons(tokens: list[str]) -> list[str]:
    """The skeletons of tokens without white space, all in one go."""
    together = NO_LETTER.sub("", "\n".join(tokens).translate(SAME))
    found = DOUBLED_ALL.sub(r"\1", together).split("\n") if tokens else []
    # A few numerals pass for letters in patterns.
    return [b if not b or b.isalpha() else skeleton(t) for t, b in zip(tokens, found, strict=True)]


class Known:
    """Skeletons of the words and prefixes with evidence."""

    def __init__(self, shares: dict[str, float], base: float, sure: Collection[str] = ()):
        found = [f for f, share in shares.items() if share > base]
        skeleton_of = dict(zip(found, skeletons([f.removesuffix("*") for f in found]), strict=True))
        self.words = {bones for f, bones in skeleton_of.items() if not f.endswith("*")}
        self.prefixes = {bones for f, bones in skeleton_of.items() if f.endswith("*")}
        self.sizes = sorted(set(map(len, self.prefixes)))
        self.least, self.most = min(self.sizes, default=0), max(self.sizes, default=0)
        self.heads = {p[: self.least] for p in self.prefixes}
        self.longest = max(map(len, found), default=0)
        # The highest share of what begins so, of prefixes and of words; features that decide alone have any.
        self.begun: dict[str, float] = {}
        self.own: dict[str, float] = {}
        self.whole: dict[str, float] = {}
        for feature, bones in skeleton_of.items():
            share = ANY if feature in sure else shares[feature]
            for n in range(len(bones) + 1):
                self.begun[bones[:n]] = max(share, self.begun.get(bones[:n], 0.0))
            of = self.own if feature.endswith("*") else self.whole
            of[bones] = max(share, of.get(bones, 0.0))
        self.reaches = {bones: max(ahead, self.worth(bones)) for bones, ahead in self.begun.items()}
        self._beginnings: dict[str, tuple[int, float] | tuple[()]] = {}
        self._pairs: dict[tuple[str, str], float] = {}

    def reach(self, bones: str) -> float:
        """The highest share that a word may have whose skeleton begins so and goes on; 0 if nothing known does."""
        return self.reaches.get(bones, 0.0)

    def worth(self, bones: str) -> float:
        """The highest share that a word with this skeleton may have."""
        return max([self.whole.get(bones, 0.0), *(self.own.get(bones[:n], 0.0) for n in self.sizes)])

    def beginning(self, bones: str) -> tuple[int, float]:
        """Size of the longest known prefix that a skeleton begins with, -1 if there is none, and the highest share of all."""
        start = bones[:START]
        # What nothing known begins with has no longer prefix; the first letters tell it of most words.
        if len(start) == START and start in self.begun:
            self._beginnings[start] = ()
            start = bones[: max(self.most, START + 1)]
        found = self._beginnings.get(start)
        if not found:
            own = [(n, self.own[start[:n]]) for n in self.sizes if start[:n] in self.own]
            found = (own[-1][0], max(share for _, share in own)) if own else (-1, 0.0)
            if len(self._beginnings) > KNOWN:
                self._beginnings.clear()
            if start not in self.begun or len(start) != START:
                self._beginnings[start] = found
        return found

    def may_have(self, token: str, bones: str) -> bool:
        """Whether any reading of a token with this skeleton may have evidence; never wrongly False.

        All of them begin with what stands in front of the first sign that looks like a letter.
        """
        sign = None if token.isalpha() else SIGN.search(token)
        front = skeleton(token[: sign.start()]) if sign else bones
        return front in self.begun or self.beginning(front)[0] >= 0

    def may_be(self, token: str) -> bool:
        """Whether a reading of the token may have evidence."""
        if "*" in token:
            return self.may_begin(token)
        return self.holds(skeleton(token))

    def holds(self, bones: str) -> bool:
        """Whether a skeleton is that of a word with evidence, or begins with that of a prefix."""
        if bones in self.words:
            return True
        return bones[: self.least] in self.heads and any(bones[:n] in self.prefixes for n in self.sizes)

    def may_begin(self, token: str) -> bool:
        """Whether what stands in front of the token's first sign may begin a word with evidence."""
        bones = skeleton(token[: next((at for at, c in enumerate(token) if c in ALIKE), len(token))])
        return bones in self.begun or any(bones[:n] in self.prefixes for n in self.sizes)

    def _pair(self, pair: tuple[str, str], looks: dict[str, Look]) -> float:
        """The highest share that a token joined with the next one may come to, whatever follows; remembered."""
        bones, more = (looks[token][2] for token in pair)
        chance = ANY
        if more and "*" not in pair[1]:
            before = len(bones)
            bones += more[1:] if bones and bones[-1] == more[0] else more
            chance = self.reaches.get(bones, 0.0)
            size, share = self.beginning(bones)
            if size >= before or bones in self.words:
                chance = max(chance, share, self.whole.get(bones, 0.0))
        if len(self._pairs) > KNOWN:
            self._pairs.clear()
        self._pairs[pair] = chance
        return chance

    def joined(self, words: list[str], opening: set[str], looks: dict[str, Look], enough: float) -> Iterator[int]:
        """Places of tokens that, joined with the next ones, may be read as a word with more evidence than ``enough``.

        ``opening`` has the tokens with which such a word may begin; ``looks`` gives skeletons.
        """
        short = list(map(SHORT.__ge__, map(len, words)))
        words_, reaches, whole, longest = self.words, self.reaches, self.whole, self.longest
        pairs, beginnings, beginning = self._pairs, self._beginnings, self.beginning
        for at in compress(range(len(words) - 1), map(opening.__contains__, words)):
            if short[at + 1]:
                pair = words[at], words[at + 1]
                chance = pairs.get(pair)
                if (self._pair(pair, looks) if chance is None else chance) <= enough:
                    continue
            elif not short[at]:
                continue
            bones, letters = looks[words[at]][2], 1
            for nxt in range(at + 1, len(words)):
                token = words[nxt]
                if not short[nxt] and not short[nxt - 1]:
                    break
                if "*" in token:
                    yield at
                    break
                more = looks[token][2]
                if not more:
                    continue
                before, letters = len(bones), letters + 1
                bones += more[1:] if bones and bones[-1] == more[0] else more
                # A known word, or one with a known prefix that the token in front didn't go beyond.
                size, share = beginnings.get(bones[:START]) or beginning(bones)
                if (size >= before or bones in words_) and max(share, whole.get(bones, 0.0)) > enough:
                    yield at
                    break
                if reaches.get(bones, 0.0) <= enough or letters > longest:
                    break


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)] if word else []


def family(text: bytes) -> int:
    """The same number for most near copies of a text: the least hash of its five-word shingles."""
    words = text.lower().split()
    shingles = (b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return min(map(xxhash.xxh64_intdigest, shingles)) >> 1


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: str = "true",
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """The model of a corpus. Labels are those of rows for which ``learnable`` (SQL on the id) holds.

    At most ``sample`` of them, by a hash of the id, are used; the letter counts cover all texts.
    NULL labels and ids teach nothing. An id labelled twice counts as toxic if one label says so.
    Without toxic labels the model scores everything 0.
    """
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    grams = count_letters(rows).toPandas()  # at most 28^4 rows
    costs = letter_costs(grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.int64))
    plain = Model(costs, {}, 0.0, {})
    given = (
        labels.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{label}` AS int) AS toxic")
        .filter(f"doc_id IS NOT NULL AND toxic IN (0, 1) AND ({learnable})")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    taught = rows.join(F.broadcast(given), "doc_id")  # at most ``sample`` ids
    half = [f"CAST(count_if(family & 1 = {k}) AS double) AS " for k in (0, 1)]
    # Only what enough toxic families hold can be a feature, so clean texts are searched for that alone.
    toxic = _opened(taught.filter("toxic = 1"), plain).groupBy("feature").agg(*[F.expr(f"{half[k]}bad{k}") for k in (0, 1)])
    bad = toxic.filter(f"feature = '' OR bad0 + bad1 >= {SUPPORT}").toPandas()  # bounded by the sample
    if bad.empty:
        return plain
    wanted = Model(costs, dict.fromkeys(bad["feature"], 1.0), 0.0, {})
    clean = _opened(taught.filter("toxic = 0"), wanted).groupBy("feature").agg(*[F.expr(f"{half[k]}good{k}") for k in (0, 1)])
    found = bad.merge(clean.toPandas(), how="outer", on="feature").fillna(0.0)
    for k in (0, 1):
        found[f"n{k}"] = found[f"bad{k}"] + found[f"good{k}"]
    worthy = (found["bad0"] + found["bad1"]) >= LEAST / 2 * (found["n0"] + found["n1"])
    found = found[worthy | (found["feature"] == "")]
    models = [_shares(costs, found, keep, plain.key[0]) for keep in ((1,), (0,), (0, 1))]
    if not models[-1].base:
        return plain

    def summaries() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        by_half = [m.summary() for m in models[:2]]  # of texts in half 0 by what half 1 taught, and conversely

        def summarise(part: pa.RecordBatch) -> pa.RecordBatch:
            raws = texts(part)
            own = [family(raw) for raw in raws]
            x: list = [None] * len(raws)
            for half, summary in enumerate(by_half):
                places = [i for i, f in enumerate(own) if f & 1 == half]
                for i, (values, _) in zip(places, summary.of([raws[i].decode() for i in places]), strict=True):
                    x[i] = values
            columns = [part.column("toxic"), pa.array(own, pa.int64()), pa.array(x, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, ["toxic", "family", "x"])

        return summarise

    rows_ = map_text(taught, summaries, "toxic int, family bigint, x array<double>").toPandas()  # ``sample`` rows
    weight = 1 / rows_.groupby("family")["family"].transform("size").to_numpy(np.float64)
    x, y = np.array(rows_["x"].tolist(), np.float64), rows_["toxic"].to_numpy(np.float64)
    whole = models[-1]
    return Model(costs, whole.shares, whole.base, whole.sure, regression(x, y, weight))


def _opened(taught: DataFrame, model: Model) -> DataFrame:
    """feature and family, each pair once: the features of texts; only those of the model if it has any.

    Every text has the feature ''.
    """

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known: dict[str, tuple[str, ...]]
        own = "toxicity", ("opened", model.key[0])  # forgotten for what is remembered of scores
        known, gate = per_worker(own, lambda: ({}, Known(model.shares, 0.0) if model.shares else None))

        def of(words: list[str]) -> tuple[str, ...]:
            found = dict.fromkeys(f for word in words for f in word_features(word))
            return tuple(f for f in found if gate is None or f in model.shares)

        def open_features(part: pa.RecordBatch) -> pa.RecordBatch:
            features, families = [], []
            with uncollected():
                for raw in texts(part):
                    if len(known) > OPENED:
                        known.clear()
                    own = {""}
                    words = raw.decode().lower().split()
                    for token in {word.strip(AROUND) for word in words}:
                        if token not in known:
                            hopeless = gate is not None and not gate.may_have(token, skeleton(token))
                            known[token] = () if hopeless else of(model.words(token, gate))
                        own.update(known[token])
                    for run in runs_at(words, spaced(words)):
                        own.update(of(model.joined(run)))
                    features += own
                    families += [family(raw)] * len(own)
            columns = [pa.array(features, pa.string()), pa.array(families, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["feature", "family"])

        return open_features

    return map_text(taught, work, "feature string, family bigint").distinct()


def _shares(costs: np.ndarray, found: pd.DataFrame, halves: tuple[int, ...], number: str) -> Model:
    """A model without weights from the counts of some halves of the families."""
    n = sum(found[f"n{k}"].to_numpy(np.float64) for k in halves)
    bad = sum(found[f"bad{k}"].to_numpy(np.float64) for k in halves)
    everything = (found["feature"] == "").to_numpy()
    base = float(bad[everything].sum() / max(1.0, n[everything].sum()))
    share = (bad + PRIOR * base) / (n + PRIOR)
    kept = (share >= LEAST) & (share > base) & ~everything
    names = found["feature"].to_numpy()
    # Wilson's bound: the least share that the counts are still credible for.
    p, z = bad / np.maximum(n, 1), WIDTH**2 / np.maximum(n, 1)
    bound = (p + z / 2 - np.sqrt(z * (p * (1 - p) + z / 4))) / (1 + z)
    short = np.array([len(f) <= PREFIXES[0] + 1 and f.endswith("*") for f in names], bool)  # too easily met by chance
    sure = kept & (bound >= DECISIVE) & ~short
    chosen = [dict(zip(names[k], v[k].tolist(), strict=True)) for k, v in ((kept, share), (sure, bound))]
    return Model(costs, chosen[0], base, chosen[1], key=(number, str(halves)))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row. Other columns are ignored.

    NULL and empty texts score what the regression gives for the base rate alone.
    """

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def scored(part: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.scores([t or "" for t in part.column("text").to_pylist()])
            columns = [part.column("doc_id"), pa.array(scores, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "score"])

        return scored

    kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return map_text(rows, work, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def clean(part: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.scores([t or "" for t in part.column(text_col).to_pylist()])
            return part.filter(pa.array([score < threshold for score in scores], pa.bool_()))

        return clean

    return map_text(docs, work, docs.schema, text_col)
