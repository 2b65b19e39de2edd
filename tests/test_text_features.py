import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from marketloom.operators import text_features
from marketloom.session import shared_folder


def grams(text, n_max):
    words = (text or "").lower().split()
    return [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]


def texts(n=120, seed=3):
    random.seed(seed)
    pool = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [" ".join(random.choices(pool, weights, k=random.randint(0, 30))) for _ in range(n)] + [None, "", "w0 w0 w0"]


@pytest.mark.parametrize("cells", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("n", [1, 25, 10_000])
def test_frequent_terms_are_exact_however_terms_share_cells(frame, cells, n):
    data = texts()
    df = frame([(t,) for t in data], "t string").repartition(5)
    got = text_features.frequent_terms(df, text_features.TextTokens(inputCol="t", nMax=3).column(), n, cells)
    total, rows = Counter(), Counter()
    for t in data:
        total.update(grams(t, 3))
        rows.update(set(grams(t, 3)))
    want = sorted(total, key=lambda g: (-total[g], g))[:n]
    assert {(r.term, r.total, r.df) for r in got.collect()} == {(g, total[g], rows[g]) for g in want}


def test_flat_counts_take_the_third_pass(frame):
    """All terms tie, so the fullest cells do not settle it; the first names win."""
    df = frame([(f"t{i:03d}",) for i in range(300)], "t string")
    got = text_features.frequent_terms(df, F.array("t"), 20, 100)
    assert sorted(r.term for r in got.collect()) == [f"t{i:03d}" for i in range(20)]


def test_fit_then_unseen_rows_then_saved(spark, frame):
    train = texts()
    df = frame([(t,) for t in train], "t string")
    unseen = frame([(0, "W0 w1 w1 never"), (1, "never seen"), (2, None), (3, "")], "k int, t string")
    stage = text_features.TextTerms(inputCol="t", outputCol="f", nMax=2, maxFeatures=30)
    model = Pipeline(stages=[stage]).fit(df)
    folder = shared_folder(spark, "text-model")
    model.write().save(folder)
    again = PipelineModel.load(folder)
    terms = text_features.vocabulary(model.stages[0])
    assert terms == text_features.vocabulary(again.stages[0]) and len(terms) == 30
    held = {g: sum(g in grams(t, 2) for t in train) for g in terms}
    raw = {g: n * (np.log((len(train) + 1) / (held[g] + 1)) + 1) for g, n in Counter(grams("w0 w1 w1", 2)).items() if g in held}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    for fitted in (model, again):
        out = text_features.term_weights(fitted.transform(unseen), "k", "f", terms).collect()
        assert {r.k for r in out} == {0} and len(out) == len(raw)
        assert {r.term: r.weight for r in out} == pytest.approx({g: v / norm for g, v in raw.items()})


def test_applying_exchanges_nothing(frame):
    df = frame([("a b",), ("b c",)], "t string")
    out = text_features.TextTerms(inputCol="t", outputCol="f").fit(df).transform(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_no_terms_is_an_error(frame):
    with pytest.raises(ValueError):
        text_features.TextTerms(inputCol="t").fit(frame([(None,), ("",)], "t string"))


@pytest.mark.parametrize("keys", ["hashed", "equal"])
def test_ngrams_counted_in_slices_by_number(monkeypatch, keys):
    """Slices of whole texts, a long one by itself; runs that share a key are told apart by their words."""
    import pyarrow as pa

    monkeypatch.setattr(text_features, "WORDS_PER_SLICE", 7)
    if keys == "equal":
        monkeypatch.setattr(text_features.pd.util, "hash_array", lambda names, categorize: np.zeros(len(names), dtype=np.uint64))
    data = [None if t is None else t.split() for t in texts(40)]
    total, held = Counter(), Counter()
    for part in text_features._slices([pa.RecordBatch.from_arrays([pa.array(data, pa.list_(pa.string()))], names=["words"])]):
        assert len(part.codes) <= 7 or len(set(part.owner)) == 1
        for size, starts, hashed in text_features._runs(part, 2, 4):
            for term, n, df in zip(*(c.to_pylist() for c in text_features._counts(part, size, starts, hashed))):
                total[term] += n
                held[term] += df
    want = [[g for g in grams(" ".join(t or []), 4) if " " in g] for t in data]
    assert total == Counter(g for t in want for g in t) and held == Counter(g for t in want for g in set(t))


def test_ngrams_are_not_built_as_rows(frame):
    """The passes of a fit read the words of a text, and each run of words becomes a row only where it can matter."""
    df = frame([("a b a b",), ("b a",), (None,)], "t string")
    got = text_features.frequent_ngrams(df, F.split("t", " "), 3, 1, 2).collect()
    assert {(r.term, r.total, r.df) for r in got} == {("a", 3, 2), ("b", 3, 2), ("a b", 2, 1)}
