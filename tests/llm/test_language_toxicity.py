import math
import random
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import language, toxicity

from .data import SCHEMA, sentence

SYLLABLES = {"aa": ["ka", "lo", "mi", "ten", "ur"], "bb": ["sch", "ver", "ung", "ein", "er"], "cc": ["eau", "que", "oi", "ment", "ré"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, prose(rng, lang, rng.randint(8, 60)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.createDataFrame(texts(1, 400), "doc_id long, text string, lang string"), docs_per_language=60)


def test_unseen_texts_get_their_language(spark, model):
    rows = texts(2, 200)
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and not r["lang_rejected"] and 0 <= r["lang_score"] <= 1 for r in out) and len(out) == 200


def test_probabilities_add_up_to_one(model):
    """Over all letters that training saw, the end of the word, and one share for the unknown."""
    alphabet = sorted({c for s in SYLLABLES.values() for x in s for c in x})
    for start in ["", "k", "ka", "sch", "vér", "zzz"]:
        codes, at = language.symbols([start + c for c in alphabet] + [start] * (start != ""))
        total = np.zeros(len(model.languages))
        logs = language.log_probabilities(model, codes, at)
        ends, step = np.cumsum([len(start) + 2] * len(alphabet)), 0
        total += np.exp(logs[ends - 2]).sum(0)
        total += np.exp(logs[-1]) if start else 0  # after nothing no word ends, but its share is held
        unknown, place = language.symbols([start + "ñ"])
        total += np.exp(language.log_probabilities(model, unknown, place)[len(start)])
        assert (total <= 1 + 1e-4).all() and (total > (0.9 if start else 0.6)).all(), (start, total, step)


def kneser_ney(words, order=4):
    """Textbook recursion on strings, for one language."""
    edge = "\n"
    grams = {n: Counter() for n in range(1, order + 1)}
    raw = Counter()
    for w in words:
        s = edge * (order - 1) + w + edge
        for i in range(order - 1, len(s)):
            raw[s[i - order + 1 : i + 1]] += 1
    grams[order] = raw
    for n in range(order - 1, 0, -1):
        starts, kinds = Counter(), Counter()
        for g, c in raw.items():
            starts[g[order - n :]] += c
        for g in {x[order - n - 1 :] for x in raw}:
            kinds[g[1:]] += 1
        grams[n] = Counter({g: starts[g] if n > 1 and g[0] == edge else kinds[g] for g in kinds})
    alphabet = len({g[-1] for g in raw}) + 1

    def prob(history, c, n):
        if n == 0:
            return 1 / alphabet
        h = history[len(history) - n + 1 :]
        row = {g[-1]: k for g, k in grams[n].items() if g[:-1] == h}
        ones, twos = (sum(1 for k in grams[n].values() if k == v) for v in (1, 2))
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95) if ones else 0.5
        if not row:
            return prob(history, c, n - 1)
        total = sum(row.values())
        return max(row.get(c, 0) - d, 0) / total + d * len(row) / total * prob(history, c, n - 1)

    return lambda w: [math.log(prob((edge * 3 + w + edge)[i - 3 : i], (edge * 3 + w + edge)[i], order)) for i in range(3, len(w) + 4)]


def test_model_equals_the_textbook_recursion(spark):
    rng = random.Random(5)
    words = prose(rng, "aa", 300).split()
    rows = [(i, " ".join(words[i * 10 : i * 10 + 10]), "aa") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_language=10_000)
    want = kneser_ney(words)
    for w in ["kalo", "mi", "tenur", "xyz", "kax", "urk"]:
        codes, at = language.symbols([w])
        assert language.log_probabilities(model, codes, at)[:, 0].tolist() == pytest.approx(want(w), abs=1e-4)


def test_texts_without_letters_and_strange_ones_are_rejected(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? ½"), (4, "字符 " * 40), (5, "xqzjw xqzjw wjqzx " * 20), (6, prose(random.Random(9), "bb", 3000))]
    df = spark.createDataFrame([(i, t, "x", "s", 0, "r", 1, "k", 2, 3) for i, t in rows], SCHEMA)
    out = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(out[i]["lang_score"] == 0 for i in (1, 2, 3))
    assert [out[i]["lang_rejected"] for i in range(1, 7)] == [True] * 5 + [False] and out[6]["lang_pred"] == "bb"
    assert out[4]["lang_pred"] in SYLLABLES


@pytest.mark.parametrize("languages", [list(SYLLABLES), ["aa", "bb"], ["cc"]])
def test_small_languages_reject_too(spark, languages):
    """All documents are counted, as there are fewer than the bound; "bb" has 12 only."""
    rows = [r for r in texts(3, 250) if r[2] in languages and (r[2] != "bb" or r[0] < 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(languages) and np.isfinite(model.limits).all()
    strange = [(i, "xqzjw xqzjw wjqzx " * 20, None) for i in range(1000, 1003)]
    unseen = [r for r in texts(4, 100) if r[2] in languages]
    out = language.identify(spark.createDataFrame(strange + unseen, "doc_id long, text string, lang string"), model).collect()
    assert all(r["lang_rejected"] == (r["doc_id"] >= 1000) for r in out) and len(out) == 3 + len(unseen)


def test_language_without_labels_or_rows(spark, model):
    none = spark.createDataFrame([(1, "ab", None)], "doc_id long, text string, lang string")
    assert language.fit(none) is None
    assert [(r["lang_pred"], r["lang_score"]) for r in language.identify(none, None).collect()] == [("und", 0.0)]
    assert language.identify(spark.createDataFrame([], SCHEMA), model).collect() == []


BAD = ["idiot", "moron", "scumbag"]


def toxic_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, "aa", rng.randint(5, 120)).split()
        label = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) if label else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if not label and rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), "village idiot")
        rows.append((i, " ".join(words), int(label)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    df = spark.createDataFrame(toxic_rows(1, 600), "doc_id long, text string, toxic int")
    return toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_unseen_toxic_texts_are_found_and_exceptions_spared(spark, toxic_model):
    df = spark.createDataFrame(toxic_rows(2, 300), "doc_id long, text string, toxic int")
    out = toxicity.score(df, toxic_model).collect()
    assert len(out) == 300 and all(r["toxic_pred"] == r["toxic"] and 0 <= r["toxicity"] <= 1 for r in out)
    assert "village idiot" in toxic_model.exceptions


def test_folding(spark, toxic_model):
    rows = [(1, "such a m0r0n here"), (2, "МОRОN, really"), (3, "ｉｄｉｏｔ!"), (4, "kalo mi"), (5, None), (6, ""), (7, "1d1ot"), (8, "kamoron")]
    df = spark.createDataFrame([(i, t, "x", "s", 0, "r", 1, "k", 2, 3) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["toxic_pred"] for r in toxicity.score(df, toxic_model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0}


def test_hits_equal_a_scan_by_hand(toxic_model):
    automaton = toxicity._automaton(toxic_model)
    for _, text, _ in toxic_rows(3, 40):
        plain = toxicity.folded(text)
        want = sorted({plain.index(" " + w + " ", i) for w in BAD for i in range(len(plain)) if plain.startswith(" " + w + " ", i) and not plain[:i].endswith(" village")})
        assert [s for s, _, _ in toxicity.hits(automaton, plain)] == want


def test_toxicity_without_labels_or_rows(spark, toxic_model):
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.fit(empty.select("doc_id", "text"), empty.select("doc_id", "toxic"))
    assert model.lexicon == {} and toxicity.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model).count() == 1
    assert toxicity.score(empty, toxic_model).collect() == []


def test_calibration_scores_each_text_once(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, sentence(rng, 40, "abcd" if i % 2 else "wxyz"), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    passes, collect = [], type(docs).collect

    def counted(df):
        passes.append(df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython"))
        return collect(df)

    monkeypatch.setattr(type(docs), "collect", counted)
    model = language.fit(docs)
    assert max(passes) == 1 and all(0 < x < 100 for x in model.limits)
