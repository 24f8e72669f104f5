"""Fitted operators: held-out accuracy, restored words and defined results."""

from __future__ import annotations

import gc
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from bylines.llm import languages, toxicity
from bylines.llm.queries import QUERIES

from llm_support import AWKWARD

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    """A tenth of the largest sample's ids, for models that need more than 200 texts."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").filter("doc_id % 3 = 0").repartition(8).cache()
    return docs, spark.read.parquet(f"{LARGER}/labels.parquet")


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    held = "crc32(CAST(doc_id AS string)) % 3 = 1"
    model = toxicity.fit(docs, labels, learnable=f"NOT ({held})")
    scored = toxicity.score_texts(docs, model).filter(held).join(labels.dropDuplicates(["doc_id"]), "doc_id").collect()
    pairs = [(r["score"], r["toxic"]) for r in scored if r["toxic"] is not None]
    assert all(0 <= s <= 1 for s, _ in pairs)
    bad, good = ([s for s, t in pairs if t == v] for v in (1, 0))
    above = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert above > 0.85
    caught = [t for s, t in pairs if s >= toxicity.THRESHOLD]
    assert sum(caught) / len(caught) > 0.9
    assert sum(caught) / len(bad) > 0.6

    score = model.scorer()
    plain = "the and idiot of them moron as stupid was"
    assert score(plain) >= toxicity.THRESHOLD
    for hidden in ("1d10t", "i-d-i-o-t", "iiidiooot", "id!0t", "i d i o t", "IDIOT,"):
        assert score(plain.replace("idiot", hidden)) == pytest.approx(score(plain), abs=0.05)
    assert score("the and 1d10t of them m0ron as stupiiiid was") >= toxicity.THRESHOLD
    assert score("the and them of it") < 0.3


def test_restored_words(documents):
    counts = toxicity.count_letters(documents).toPandas()
    costs = toxicity.letter_costs(counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    assert np.allclose(np.exp(-costs.astype(float)).sum(axis=-1), 1, atol=1e-3)
    model = toxicity.Model(costs, {}, 0.0, {})
    for raw, word in (("th4t", "that"), ("tthhhat", None), ("t-h-a-t", "that"), ("ciónnnn", None)):
        assert model.restore(raw) == word or word is None
    assert model.restore("é") == "é"


def test_signs_and_doubled_letters_are_read(documents):
    counts = toxicity.count_letters(documents).toPandas()
    costs = toxicity.letter_costs(counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    model = toxicity.Model(costs, {"that": 0.95, "this": 0.9}, 0.1, {"that": 0.93})
    for raw in ("that", "tha+", "+hat", "(+hat)", "thaat", "tthat", "7h47", "th@t!!", "+#@+", "that!", "(that)."):
        assert model.evidence(raw) == (0.95, 0.93, "that"), raw
    for raw in ("!!!", "2019", "...", "", "--", "letter", "(=)"):
        assert model.evidence(raw) is None, raw
    assert toxicity.readings("a$$") == ["a", "a$$"]
    assert "loser" in (w.replace("i", "l") for w in model.words("|oser"))


def test_spaces_are_part_of_the_lattice():
    words = "such a stupid man you are an idiot i was here and said it to them all day long so that we go on".split()
    grams = toxicity.gram_counts(toxicity.letter_classes()[np.frombuffer(" ".join(words * 50).encode(), np.uint8)])
    costs = toxicity.letter_costs(np.arange(len(grams)), grams)
    known = {"stupid": 0.95, "stup*": 0.9, "idiot": 0.95}
    model = toxicity.Model(costs, known, 0.1, known, np.array([0.0] * 4 + [-9.0]))
    score = model.scorer()
    for text in (
        "such a s t u p i d man", "you are a i d i o t", "y o u i d i o t", "you stu pid man", "a st up id man",
        "i was here s-t u p 1 d so", "said it i d i o t, all", "such a stupi d", "stu pid", "an id iot " + "day " * 99,
    ):
        assert score(text) >= 0.9, text
    for text in ("such a man", "you said it to them", "st. and up to id", "s t u", "a " * 30_000, "it is - - - so", ""):
        assert score(text) < 0.1, text


def test_one_sure_word_is_enough():
    costs, weights = np.zeros([28] * 4, np.float32), np.array([0.0] * 4 + [-9.0])
    model = toxicity.Model(costs, {"vile": 0.95}, 0.1, {"vile": 0.93}, weights)
    assert model.scorer()("word " * 5000 + "vile.") == 0.93
    assert model.scorer()("word " * 5000) < 0.01


def test_letter_counts_cover_every_text(spark, documents, texts):
    got = {r["gram"]: r["n"] for r in toxicity.count_letters(documents).collect()}
    want = Counter()
    for text in texts.values():
        classes = [ord(c) - 96 if 97 <= ord(c) <= 122 else 27 if ord(c) > 127 else 0 for c in _bytes(text)]
        word = [0, 0, 0]
        for c in [*classes, 0]:
            if c or word[-1]:
                want[word[-1] * 28 + word[-2] * 28**2 + word[-3] * 28**3 + c] += 1
            word = [*word[-2:], c] if c else [0, 0, 0]
    inner = {g: n for g, n in got.items() if g % 28}
    assert inner == {g: n for g, n in want.items() if g % 28}


def _bytes(text):
    return "".join(map(chr, text.encode().lower()))


def test_toxicity_defined_results(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (5, 0), (None, 1), (9, None), (77, 1)], "doc_id bigint, toxic int"
    )
    model = toxicity.fit(awkward, labels)
    rows = toxicity.score_texts(awkward, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    assert all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.fit(nothing, labels.filter("false"))
    assert toxicity.score_texts(nothing, none).count() == 0
    assert {r["score"] for r in toxicity.score_texts(awkward, none).collect()} == {0.0}
    assert toxicity.keep_clean(awkward, none).count() == len(AWKWARD)
    assert toxicity.keep_clean(awkward, none).columns == awkward.columns


def test_languages_on_held_out_rows(larger):
    docs, _ = larger
    held = "crc32(CAST(doc_id AS string)) % 4 = 2"
    field = languages.fit(docs, learnable=f"NOT ({held})")
    assert set(field.languages) == {"en", "de", "fr", "es"}
    named = languages.identify(docs, field).filter(held).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = [r["lang"] == r["lang_pred"] for r in named if r["lang"]]
    assert len(right) > 500
    assert sum(right) / len(right) > 0.97

    # Code-switched: the language changes where the text does, once.
    tag = languages.tagger(field)
    by = {}
    for r in docs.filter("length(text) BETWEEN 300 AND 900").collect():
        by.setdefault(r["lang"], r["text"])
    mixed = " ".join([*by["en"].split()[:30], *by["es"].split()[:30]])
    (lang, score, switches) = tag([mixed])[0]
    assert lang in ("en", "es")
    assert score < 0.8
    assert 1 <= switches <= 6
    assert tag([by["de"]]) == tag([by["fr"], by["de"]])[1:]


@pytest.mark.parametrize("length", [1, 40, 64, 65, 128, 500, 1000])
def test_posteriors_equal_a_plain_chain(documents, length):
    field = languages.fit(documents)
    text = " ".join(r["text"] for r in documents.orderBy("doc_id").select("text").limit(12).collect())
    words = text.split()[:length]
    assert len(words) == length
    size = len(field.languages)
    score = np.array([
        sum((field.weights[field.index[f]] for f in languages.word_features(w) if f in field.index), np.zeros(size))
        for w in words
    ])
    ahead = [score[0] + field.moves[-1]]
    for s in score[1:]:
        ahead.append(s + np.logaddexp.reduce(ahead[-1][:, None] + field.moves[:-1], axis=0))
    behind = [np.zeros(size)]
    for s in score[:0:-1]:
        behind.append(np.logaddexp.reduce(field.moves[:-1] + s + behind[-1], axis=1))
    chance = np.array(ahead) + np.array(behind[::-1])
    chance = np.exp(chance - np.logaddexp.reduce(chance, axis=1, keepdims=True))
    letters = np.array([bool(languages.LETTER.search(w)) for w in words])
    mean = chance[letters].mean(axis=0)
    tag = languages.tagger(field)
    (lang, score, _) = tag([" ".join(words)])[0]
    assert lang == field.languages[mean.argmax()]
    assert score == pytest.approx(mean.max(), abs=1e-9)
    # Beside texts of other lengths the result is the same.
    beside = [text[:5000], " ".join(words), "", "und", " ".join(words[:70]), text[100:3000]]
    assert tag(beside)[1][1] == pytest.approx(score, abs=1e-12)


def test_a_rare_language_is_learnt(spark, documents):
    common = documents.filter("lang = 'en'").select("text").limit(40).collect()
    rows = [(i, f"{common[i % len(common)]['text']} {i}", "en") for i in range(6000)]
    rows += [(7000, "zzq vvrk qqx wwzk " * 30, "xx"), (7001, "zzq vvrk qqx wwzk " * 30, "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    field = languages.fit(df)
    assert field.languages == ["en", "xx"]
    assert languages.tagger(field)(["qqx zzq vvrk wwzk qqx", common[0]["text"], "½ ² 12"]) [0][0] == "xx"
    assert languages.tagger(field)(["½ ² 12"]) == [("und", 0.0, 0)]


def test_language_defined_results(spark, awkward, nothing, documents):
    field = languages.fit(documents)
    rows = languages.identify(awkward, field).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in AWKWARD)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert got[2] == got[3] == got[4] == ("und", 0.0)
    assert languages.tagger(field)(["123 !!", "中文"])[0][0] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert languages.fit(nothing) is None
    assert {r["lang_pred"] for r in languages.identify(awkward, None).collect()} == {"und"}
    assert languages.identify(nothing, field).count() == 0


def test_queries_mark_held_out_rows(spark):
    from llm_support import SF

    for name, modulus, rest in (("op4_language_id", 4, 2), ("op6_toxicity", 3, 1)):
        for r in QUERIES[name](spark, SF).collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)


def cheapest_reading(costs, token):
    """The least cost of all readings of a token, listed one by one, and the readings that have it."""
    token = toxicity.LONG_RUN.sub(r"\1\1\1", token)

    def ways(at):
        if at == len(token):
            yield "", 0.0
            return
        run = next(n for n in (3, 2, 1) if token[at : at + n] == token[at] * n)
        for taken, letters, price in toxicity._arcs(token[at], run, at == 0 or token[at - 1] != token[at]):
            for rest, more in ways(at + taken):
                yield letters + rest, price + more

    found = {}
    for reading, price in ways(0):
        context = (0, 0, 0)
        for letter in [*reading, " "]:
            symbol = toxicity._class(letter)
            price += float(costs[context][symbol])
            context = (*context[1:], symbol) if symbol else (0, 0, 0)
        found[reading] = min(price, found.get(reading, price))
    least = min(found.values())
    return {r for r, price in found.items() if price < least + 1e-9}


def test_restored_words_are_the_cheapest_of_all(documents):
    counts = toxicity.count_letters(documents).toPandas()
    costs = toxicity.letter_costs(counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    model = toxicity.Model(costs, {}, 0.0, {})
    rng = random.Random(8)
    for _ in range(300):
        token = "".join(rng.choice("aehstt1*0$|!-. é9") for _ in range(rng.randint(1, 7))).strip()
        assert model.restore(token) in cheapest_reading(costs, token), token


def test_words_that_may_go_on_are_weighed_once(monkeypatch):
    """What may begin a known word is looked up; its prefixes are not weighed again at each place of a text."""
    known = {"stupid": 0.95, "stup*": 0.9, "idiot": 0.95}
    model = toxicity.Model(np.zeros([28] * 4, np.float32), known, 0.1, {}, np.array([0.0] * 4 + [-9.0]))
    assert model.scores(["so it is"])[0] < 0.1
    by_prefix = toxicity.Known(known, 0.1)
    assert (by_prefix.reach("st"), by_prefix.reach("stupi"), by_prefix.reach("sto")) == (0.95, 0.95, 0.0)
    monkeypatch.setattr(toxicity.Known, "worth", lambda *_: pytest.fail("weighed again"))
    assert model.scores(["s t u and so on, i d i o s t u"])[0] < 0.1


def _places(known, words, looks, enough):
    """Places from which tokens, joined one by one, come to a skeleton with enough evidence."""
    for at in range(len(words) - 1):
        bones, letters = looks[words[at]][2], 1
        for before, token in zip(words[at:], words[at + 1 :], strict=False):
            if min(len(before), len(token)) > toxicity.SHORT:
                break
            old, bones, letters = bones, toxicity.skeleton(bones + looks[token][2]), letters + bool(looks[token][2])
            if bones == old and not looks[token][2]:
                continue
            cuts = [bones[:n] for n in range(len(old) + 1, len(bones) + 1)]
            if bones in known.words or old in known.prefixes or any(c in known.prefixes for c in cuts):
                if known.worth(bones) > enough:
                    yield at
                    break
            if known.reach(bones) <= enough or letters > known.longest:
                break


def test_places_of_spaced_words():
    rng = random.Random(5)
    shares = {"stupid": 0.95, "stup*": 0.9, "idiot": 0.6, "sti*": 0.3, "is": 0.4, "tupi*": 0.8}
    known = toxicity.Known(shares, 0.1, {"stupid"})
    found = 0
    for _ in range(400):
        words = ["".join(rng.choice("stupidso-") for _ in range(rng.choice((1, 1, 2, 3, 5)))) for _ in range(12)]
        looks = {w: (None, 0.0, toxicity.skeleton(w)) for w in words}
        for enough in (0.0, 0.5, 0.92):
            opening = set(words)
            got = list(known.joined(words, opening, looks, enough))
            assert got == list(_places(known, words, looks, enough)), words
            found += len(got)
    assert found > 20


def test_counting_letters_takes_bounded_memory():
    """A batch of text is counted in pieces; the counts are those of the whole."""
    table = toxicity.letter_classes()
    text = ("An idiot, the man\u00e9  said; " * 300_000).encode()
    classes = table[np.frombuffer(text, np.uint8)]
    tracemalloc.start()
    got = toxicity.gram_counts(classes)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(text) > 8_000_000
    assert peak < 100_000_000
    want = Counter()
    before, behind_letter = (0, 0, 0), True
    for symbol in classes[:54_000].tolist():
        for c in [symbol] if symbol else [0] * 3 * behind_letter:
            want[before[0] * 28**3 + before[1] * 28**2 + before[2] * 28 + c] += 1
            before = (*before[1:], c)
        behind_letter = symbol > 0
    want[before[0] * 28**3 + before[1] * 28**2 + before[2] * 28] += 1
    assert {g: n for g, n in enumerate(toxicity.gram_counts(classes[:54_000]).tolist()) if n} == want
    for size in (1, 2, 3, 5, 64, 1000):
        pieces, toxicity.PIECE = toxicity.PIECE, size
        try:
            assert (toxicity.gram_counts(classes[:3000]) == _whole_counts(classes[:3000])).all(), size
        finally:
            toxicity.PIECE = pieces
    assert got[want.most_common(1)[0][0]] > 0
    assert toxicity.gram_counts(classes[:0]).sum() == 1


def _whole_counts(classes):
    inside = classes > 0
    classes = classes[inside | np.append(True, inside[:-1])].astype(int)
    apart = [0] * 3
    for c in classes.tolist():
        apart += [c] if c else [0] * 3
    apart = np.array([*apart, 0])
    return np.bincount(apart[3:] + 28 * (apart[2:-1] + 28 * (apart[1:-2] + 28 * apart[:-3])), minlength=28**4)


def _noisy_words(rng, known):
    """Words with and without evidence, written over, cut up, and with signs around."""
    for _ in range(12):
        word = list(rng.choice(["stupid", "idiot", "stumble", "islands", "a", "of", "letter", "tupilak", "so", "st\u00e9"]))
        for _ in range(rng.choice((0, 0, 1, 2))):
            word[rng.randrange(len(word))] = rng.choice("1!0*$.-# ti")
        yield rng.choice(("", "", "(", "$", "-", '"', "*")) + "".join(word) + rng.choice(("", "", "!!", "***", "###", ".", ",$$$"))


def test_words_without_evidence_are_left_out_unread(monkeypatch):
    """What can't begin a known word is neither restored nor weighed, and no score is other for it."""
    known = {"stupid": 0.95, "stup*": 0.9, "idiot": 0.6, "isla*": 0.3, "is": 0.4, "tupi*": 0.8}
    grams = toxicity.gram_counts(toxicity.letter_classes()[np.frombuffer(b"so it is a stupid idiot of the letter " * 50, np.uint8)])
    costs = toxicity.letter_costs(np.arange(len(grams)), grams)
    rng = random.Random(11)
    model = toxicity.Model(costs, known, 0.1, {"stupid": 0.93}, np.array([1.0, 0.5, 0.5, -0.1, -2.0]))
    gate = toxicity.Known(known, 0.1)
    for _ in range(300):
        for token in " ".join(_noisy_words(rng, known)).split():
            if model.evidence(token):
                assert gate.may_have(token, toxicity.skeleton(token)), token
    texts = [" ".join(_noisy_words(rng, known)) for _ in range(300)]
    # Beside other texts, whose words are remembered, and by itself.
    alone = [toxicity.Model(costs, known, 0.1, {"stupid": 0.93}, model.weights).scores([text])[0] for text in texts]
    assert model.scores(texts) == alone
    assert model.scores(texts[::-1]) == alone[::-1]

    monkeypatch.setattr(toxicity.Model, "restore", lambda *_: pytest.fail("read"))
    monkeypatch.setattr(toxicity.Model, "words", lambda *_: pytest.fail("read"))
    assert model.scores(["letter### lett!!, l3tter$$$ lo***"])[0] < 0.5


def test_the_collector_rests_while_texts_are_scored(monkeypatch):
    model = toxicity.Model(np.zeros([28] * 4, np.float32), {"idiot": 0.9}, 0.1, {}, np.array([0.0] * 4 + [-9.0]))
    seen = []
    together = toxicity.Summary._together
    monkeypatch.setattr(toxicity.Summary, "_together", lambda *a: seen.append(gc.isenabled()) or together(*a))
    model.scores(["so it is"])
    assert seen == [False]
    assert gc.isenabled()
