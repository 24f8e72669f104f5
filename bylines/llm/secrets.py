"""Secrets by fixed patterns and a linear-chain conditional random field.

The base patterns are searched for in the whole text. The field tags every token (a run without white
space, cut behind commas, semicolons, ampersands and braces, as in JSON and URLs) as outside a secret,
its beginning, or inside. Its features are the token's shape, the shapes
of both neighbours, and features of the text. It is trained on sequences in which the base patterns
mark the secrets, on a bounded sample; in part of them key words or values are disguised, so that it
learns from shape and neighbourhood what the patterns do not name.

Decoding is exact. Where outside leads every other tag by more than the transitions can make up, the
best path must pass through it, so Viterbi only runs over the stretches between such tokens, all
stretches of a batch at once.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import checkpointed, map_text
from bylines.llm.crf import maximise

# The base patterns and the least lengths of what counts.
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

HINTS = (*WORDS, "key", "auth", "credential", "bearer")
HINT = re.compile("(?i)" + "|".join(HINTS))
QUOTES = "\"'`,;:.()[]{}<>"
SPECIAL = re.compile("[0-9=:]")
TOKEN = re.compile(r"[^\s,;&{}]+[,;&{}]*|[,;&{}]+")
# a to z as a, A to Z as A, digits as 9, bytes beyond ASCII as u; signs stay.
CLASS_BYTES = bytes(
    ord("u") if b >= 128 else ord("a") if chr(b).islower() else ord("A") if chr(b).isupper()
    else ord("9") if chr(b).isdigit() else b for b in range(256)
)

OUTSIDE, BEGIN, INSIDE = range(3)
POOL = 40_000  # texts among which the training texts are sought, by a hash of the id
SAMPLE = 1_500  # texts with base secrets, and as many without, that the field is trained on
AROUND = 12  # tokens on either side of a secret that a training sequence holds
EPOCHS = 60
SHORTEST = 8  # characters of a span that the field adds
KNOWN = 300_000  # tokens whose features a task remembers

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base secrets, in code points, by start and then kind."""
    found: list[Span] = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"x" * 16 in text.encode().translate(HEX_BYTES):
        found += [(*m.span(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 16]
    return in_order(found)


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def entropy(token: str) -> float:
    """Bits per character."""
    counts = Counter(token)
    return -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())


def shape_features(token: str) -> tuple[str, ...]:
    """What a token looks like, never which letters it has, but for key words and values with digits."""
    core = token.strip(QUOTES)
    value = max(re.split(r"[=:]", core), key=len) if core else ""
    classes = value.encode().translate(CLASS_BYTES).decode()
    shape = re.sub(r"(.)\1+", r"\1", classes)
    found = [f"length {min(6, len(value) // 4)}", f"shape {shape if len(shape) < 6 else 'mixed'}"]
    signs = any(not c.isalnum() for c in classes)
    found.append("kinds " + "".join("ny"[k] for k in ("a" in classes, "A" in classes, "9" in classes, signs)))
    if "9" in classes and len(value) >= 8:
        found.append(f"entropy {round(2 * entropy(value))}")
        found.append(f"changes {min(9, len(re.findall('9(?=[aA])|[aA](?=9)', classes)))}")
        if all(c in string.hexdigits for c in value):
            found.append(f"hexadecimal {min(5, len(value) // 8)}")
    folded = token.lower()
    found += [f"word {w}" for w in HINTS if w in folded]
    found += [f"sign {s}" for s in "=:\"'@/" if s in token]
    return tuple(found)


def plain_key(token: str) -> tuple | None:
    """Equal for tokens with equal features; None for those with digits, = or :, which are looked at each."""
    if SPECIAL.search(token):
        return None
    hints = tuple(HINT.findall(token.lower())) if HINT.search(token) else ()
    classes = re.sub(rb"(.)\1+", rb"\1", token.encode().translate(CLASS_BYTES))
    return classes, min(6, len(token.strip(QUOTES)) // 4), hints


def text_features(text: str) -> tuple[str, ...]:
    """Features of a whole text, coarse ones."""
    lines = text.count("\n") + 1
    return (
        f"text equals {min(3, text.count('=').bit_length())}",
        f"text braces {min(2, text.count('{').bit_length())}",
        f"text lines {min(4, (len(text) // lines).bit_length() // 2)}",
    )


def window(text: str) -> tuple[list[str], list[int]]:
    """A training sequence: tokens around the first base secret with their tags, or around the oddest token."""
    spans = base_spans(text)
    if not spans:
        words = TOKEN.findall(text)
        odd = max(range(len(words)), key=lambda i: (bool(SPECIAL.search(words[i])), len(words[i])), default=0)
        words = words[max(0, odd - AROUND) : odd + AROUND + 1]
        return words, [OUTSIDE] * len(words)
    begin, end = max(0, spans[0][0] - 200), spans[0][1] + 200
    around = [m for m in TOKEN.finditer(text[begin:end])]
    around = around[begin > 0 : len(around) - (end < len(text))]  # those at the rim may be cut
    tags, last = [], -1
    for match in around:
        inside = [i for i, (a, b, _) in enumerate(spans) if a < begin + match.end() and begin + match.start() < b]
        tags.append(OUTSIDE if not inside else INSIDE if last in inside else BEGIN)
        last = inside[-1] if inside else -1
    return [m[0] for m in around], tags


ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    string.ascii_uppercase + string.digits,
    string.ascii_letters + string.digits,
    string.ascii_letters + string.digits + "_-",
    string.ascii_letters + string.digits + "+/",
)
KEYS = ("credential", "auth", "pwd", "access_key", "client_secret", "signature", "auth_token", "private_key")


def disguised(words: list[str], tags: list[int], rng: random.Random) -> list[str]:
    """The sequence with the key words of its secrets and the alphabets of their values changed."""

    def value(match: re.Match) -> str:
        alphabet = rng.choice(ALPHABETS)
        prefix = "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 4))) + rng.choice("_-")
        drawn = "".join(rng.choice(alphabet) for _ in range(rng.randint(14, 44)))
        return (prefix if rng.random() < 0.3 else "") + drawn

    def change(word: str) -> str:
        word = re.sub(r"(?i)password|passwd|secret|token|api_?key", lambda m: rng.choice(KEYS), word)
        return re.sub(r"(?=\S*[0-9])[A-Za-z0-9+/_.-]{12,}", value, word)

    return [change(w) if t else w for w, t in zip(words, tags, strict=True)]


@dataclass
class Field:
    """Weights per feature and tag, for the token itself, its neighbours and the text; transitions."""

    own: dict[str, np.ndarray]
    before: dict[str, np.ndarray]
    after: dict[str, np.ndarray]
    whole: dict[str, np.ndarray]
    moves: np.ndarray  # from tag, to tag; the row behind the last holds the starts

    def scores(self, token: str) -> np.ndarray:
        """Nine scores of a token: for its own tag, for that of the next, for that of the one before."""
        features, total = shape_features(token), np.zeros(9)
        for part, weights in enumerate((self.own, self.before, self.after)):
            for feature in features:
                if feature in weights:
                    total[3 * part : 3 * part + 3] += weights[feature]
        return total


def train(sequences: list[tuple[list[str], list[int], tuple[str, ...]]]) -> Field:
    """Weights that maximise the likelihood of the tags, by gradient steps over all sequences."""
    index: dict[tuple[str, str], int] = {}
    rows, columns, at, gold, first = [], [], 0, [], []
    for words, tags, whole in sequences:
        shapes = [shape_features(w) for w in words]
        for i, tag in enumerate(tags):
            features = [("own", f) for f in shapes[i]] + [("whole", f) for f in whole]
            features += [("before", f) for f in (shapes[i - 1] if i else ())]
            features += [("after", f) for f in (shapes[i + 1] if i + 1 < len(words) else ())]
            for feature in features:
                columns.append(index.setdefault(feature, len(index)))
                rows.append(at)
            gold.append(tag)
            first.append(i == 0)
            at += 1
    weights, moves = np.zeros((0, 3)), np.zeros((4, 3))
    if gold:
        arrays = map(np.array, (rows, columns, gold, first))
        weights, moves = maximise(*arrays, features=len(index), tags=3, epochs=EPOCHS)
    field = Field({}, {}, {}, {}, moves)
    for (part, feature), i in index.items():
        getattr(field, part)[feature] = weights[i]
    return field


def decode(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of sequences that lie end to end; ``first`` marks where one begins."""
    tags = np.zeros(len(emission), np.int64)
    # The most that two transitions, into and out of a tag, can gain over those through outside.
    gain = (moves - moves[:, :1]).max() + (moves[:3] - moves[:1]).max()
    open_ = emission[:, 1:].max(axis=1) - emission[:, 0] + max(gain, 0) >= 0
    if not open_.any():
        return tags
    at = np.flatnonzero(open_)
    fresh = np.append(True, np.diff(at) != 1) | first[at]
    starts = at[fresh]
    lengths = np.diff(np.append(np.flatnonzero(fresh), len(at)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    score = emission[starts] + np.where(first[starts][:, None], moves[3], moves[OUTSIDE])
    back, ended, longest = [], np.zeros(len(starts), np.int64), int(lengths[0])
    # Behind a stretch the path goes on outside, or the sequence ends.
    ends = starts + lengths
    more = np.where((ends < len(first)) & ~np.append(first, True)[ends], 1.0, 0.0)[:, None] * moves[:3, OUTSIDE]
    for k in range(1, longest + 1):
        live = int(np.searchsorted(-lengths, -k, side="right"))  # stretches with at least k tokens
        going = int(np.searchsorted(-lengths, -(k + 1), side="right"))
        ended[going:live] = (score[going:live] + more[going:live]).argmax(axis=1)
        if not going:
            break
        ways = score[:going, :, None] + moves[:3]
        back.append(ways.argmax(axis=1))
        score = ways.max(axis=1) + emission[starts[:going] + k]
    for i, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        tag = int(ended[i])
        for k in range(length - 1, -1, -1):
            tags[start + k] = tag
            if k:
                tag = int(back[k - 1][i, tag])
    return tags


def tagger(field: Field) -> Callable[[list[str]], list[list[Span]]]:
    """A function from texts to all their spans."""
    memory: dict[str, int] = {}
    plain: dict[tuple, int] = {}
    used, table = [-1], np.zeros((1024, 9))

    def number(token: str) -> int:
        nonlocal table
        key = plain_key(token)
        n = plain.get(key) if key else None
        if n is None:
            n = used[0] = used[0] + 1
            if n == len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            table[n] = field.scores(token)
            if key:
                plain[key] = n
        memory[token] = n
        return n

    def tag(texts: list[str]) -> list[list[Span]]:
        if len(memory) > KNOWN:
            memory.clear()
            plain.clear()
            used[0] = -1
        cut = list(map(TOKEN.findall, texts))
        counts = np.array([len(c) for c in cut], np.int64)
        get = memory.get
        ids = np.array([n if (n := get(w)) is not None else number(w) for c in cut for w in c], np.int64)
        base = [base_spans(t) for t in texts]
        if not len(ids):
            return base
        begins = (np.cumsum(counts) - counts)[counts > 0]
        first = np.zeros(len(ids), bool)
        first[begins] = True
        last = np.append(first[1:], True)
        nine = table[ids]
        emission = nine[:, :3].copy()
        emission[~first] += nine[:-1, 3:6][~first[1:]]
        emission[~last] += nine[1:, 6:9][~last[:-1]]
        whole = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            for feature in text_features(text):
                whole[i] += field.whole.get(feature, 0.0)
        emission += np.repeat(whole, counts, axis=0)
        tags = decode(emission, first, field.moves)
        tagged = np.unique(np.repeat(np.arange(len(texts)), counts)[tags > 0])
        offsets = np.cumsum(counts) - counts
        for i in tagged.tolist():
            own = tags[offsets[i] : offsets[i] + counts[i]]
            base[i] = with_tagged(texts[i], base[i], own.tolist())
        return base

    return tag


def with_tagged(text: str, base: list[Span], tags: list[int]) -> list[Span]:
    """Base spans, and those of the tags, without the signs around them, as far as no base span covers them."""
    found, start, end = [], -1, -1
    for match, tag in zip(TOKEN.finditer(text), tags, strict=True):
        if tag != INSIDE and start >= 0:
            found.append((start, end))
            start = -1
        if tag != OUTSIDE:
            start, end = (match.start() if start < 0 else start), match.end()
    if start >= 0:
        found.append((start, end))
    spans = list(base)
    for a, b in found:
        for c, d in uncovered(a, b, base):
            while c < d and not text[c].isalnum():
                c += 1
            while d > c and not (text[d - 1].isalnum() or text[d - 1] in "=+/_-"):
                d -= 1
            if d - c >= SHORTEST:
                spans.append((c, d, "crf"))
    return in_order(spans)


def uncovered(start: int, end: int, base: list[Span]) -> list[tuple[int, int]]:
    """The parts of a stretch of text that lie in none of the spans, which are sorted by their start."""
    parts = []
    for a, b, _ in base:
        if a >= end:
            break
        if a > start:
            parts.append((start, a))
        start = max(start, b)
    return [*parts, (start, end)] if start < end else parts


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, pool: int = POOL
) -> Field:
    """The field, trained on at most ``sample`` texts with base secrets and as many without.

    They are sought among ``pool`` texts, those with the least hashes of their ids.
    """
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").filter("text IS NOT NULL")
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = rows.filter("doc_id IS NOT NULL").select("doc_id", order.alias("order"))
    chosen = chosen.distinct().orderBy("order", "doc_id").limit(pool)

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def cut(part: pa.RecordBatch) -> pa.RecordBatch:
            found = part.column("text").to_pylist()
            cuts = [window(t) for t in found]
            columns = [
                part.column("order"),
                pa.array([BEGIN in tags for _, tags in cuts], pa.bool_()),
                pa.array([words for words, _ in cuts], pa.list_(pa.string())),
                pa.array([tags for _, tags in cuts], pa.list_(pa.int32())),
                pa.array([list(text_features(t)) for t in found], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["order", "marked", "words", "tags", "whole"])

        return cut

    schema = "order bigint, marked boolean, words array<string>, tags array<int>, whole array<string>"
    cuts = map_text(rows.join(F.broadcast(chosen), "doc_id").select("order", "text"), work, schema)
    cuts = checkpointed(cuts.filter("size(words) > 0"))  # at most ``pool`` rows
    halves = (cuts.filter(F.col("marked") == marked) for marked in (True, False))
    taken = [row for half in halves for row in half.orderBy("order", "words").limit(sample).collect()]
    rng = random.Random(7)
    sequences = [(r["words"], r["tags"], tuple(r["whole"])) for r in taken]
    sequences += [(disguised(w, t, rng), t, whole) for w, t, whole in sequences if BEGIN in t]
    return train(sequences)


def find_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (start, end, kind), of every row.

    Spans are in code points, end exclusive, by start and then kind; kind is one of assign, access
    and hex (the base patterns, which may overlap) and crf (tagged, and covered by no base span). NULL
    and empty texts have none. Rows that repeat each get their spans. Other columns are ignored.
    """

    def work() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        tag = tagger(field)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

        def find(part: pa.RecordBatch) -> pa.RecordBatch:
            spans = tag([t or "" for t in part.column("text").to_pylist()])
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

        return find

    id_kind = dict(docs.dtypes)[id_col]
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return map_text(rows, work, f"doc_id {id_kind}, spans array<struct<start: int, `end`: int, kind: string>>")
