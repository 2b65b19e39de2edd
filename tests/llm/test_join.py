import random
from collections import defaultdict

import numpy as np
import pytest

from marketloom.llm import chosen_path as cp
from marketloom.llm.common import components

from .data import SCHEMA, corpus, sentence


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_brute_force(rows):
    """(class, links) by row number, over all pairs."""
    sets = [shingles(r[1]) for r in rows]
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                near[i].add(j)
                near[j].add(i)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if label[y] > label[i]:
                    label[y] = label[i]
                    todo.append(y)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[label[i]].append(r[0])
    return [(min((x for x in least[label[i]] if x is not None), default=None), len(near[i])) for i in range(len(rows))]


def family(seed, size, words=60):
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "".join(rng.choice("xyz") for _ in range(4))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 6, "WHOLE": 6, "BLOCK": 8}, {"BUCKET": 6, "WHOLE": 6, "BLOCK": 8, "DENSE_SHARE": 2.0}])
def test_join_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(cp, name, value)
    rows = corpus(2)
    rows += [(1000 + i, t, *rows[0][2:]) for i, t in enumerate(family(5, 60) + family(6, 15, 21))]
    rows += [(None, rows[2][1], *rows[0][2:]), rows[8], rows[8]]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in cp.similarity_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = sorted(((r[0], c, n) for r, (c, n) in zip(rows, by_brute_force(rows))), key=repr)
    assert got == want


def test_near_dedup_keeps_the_least_id_of_each_class(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows + [rows[3]], SCHEMA)
    kept = cp.near_dedup(df)
    assert kept.columns == df.columns
    want = sorted(r[0] for r, (c, _) in zip(rows, by_brute_force(rows)) if c == r[0] or not shingles(r[1]))
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_empty_table_and_texts_without_words(spark):
    assert cp.similarity_join(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, t, "en", "s", 0, "r", 1, "k", 2, 3) for i, t in enumerate([None, "", " \n"])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in cp.similarity_join(df).orderBy("doc_id").collect()] == [(i, i, 0, 0) for i in range(3)]
    assert cp.near_dedup(df).count() == 3


def test_shingle_sets_match_python_sets():
    texts = [r[1] or "" for r in corpus(7)] + ["a b c d e\tf", "é ü\x1cö", "word " * 40]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    _, owner = cp.shingle_sets(np.frombuffer(data, np.uint8), offsets, 5)
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]


def test_runs_follow_the_target_recall():
    assert cp.runs_for(0.9) < cp.runs_for(0.999) and cp.runs_for(0.999995) == 13


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 200 + i) for i in range(50)] + [(300, 301), (301, 299)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[200 + i] == 7 for i in range(50)) and {got[x] for x in (299, 300, 301)} == {299}
