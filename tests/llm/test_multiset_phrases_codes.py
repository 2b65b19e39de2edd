"""Multiset fingerprints, collocations and vector codes against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import collocations, multiset_hash, queries, vector_codes
from tests.llm.data import SCHEMA, corpus

PARAGRAPH = re.compile(r"[^.!?\x0a-\x0d]+[.!?]*|[.!?]+")


def split(text):
    return Counter(p.strip(" ") for p in PARAGRAPH.findall(text or ""))


def chain(rows):
    """Rows by descending id, null last, then by hash: each with the next one."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return list(zip(ordered, ordered[1:] + ordered[:1]))


def edited(text, beyond):
    half = len(text) // 2
    return text[: len(text) - half] + beyond[:half]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in corpus(seed=3, docs=30)]
    rows += [(1000, "First. Second! Third?\nFourth"), (1001, "Third?\nFourth\nSecond!First."), (1000, "First. Second! Third?\nFourth"), (1000, "other"), (None, "no id. at all."), (None, None)]
    rows += [(1002, "".join(f"Line {rng.randrange(50)} of many.\n" for _ in range(30_000))), (1003, "...!!!"), (1004, "é. ü. \U0001f600. x"), (1000, "First. Second! Third?\nFourth")]
    return rows


def test_fingerprints_equal_as_multisets_are(spark, texts):
    told = multiset_hash.fingerprints(spark.createDataFrame([(i, t, "k", 1) for i, (_, t) in enumerate(texts)], "doc_id long, text string, key string, vector int")).collect()
    seen = {r["doc_id"]: r for r in told}
    assert len(told) == len(texts)
    by = defaultdict(set)
    for i, (_, t) in enumerate(texts):
        assert seen[i]["n_chars"] == len(t or "") and seen[i]["n_paragraphs"] == sum(split(t).values())
        by[frozenset(split(t).items())].add(tuple(seen[i]["fingerprint"]))
    assert all(len(x) == 1 for x in by.values())
    assert len({next(iter(x)) for x in by.values()}) == len(by)


def test_fingerprints_follow_insertion_and_deletion(spark):
    rng = random.Random(1)
    a, b = [f"p{rng.randrange(9)}." for _ in range(40)], [f"q{rng.randrange(9)}." for _ in range(25)]
    rows = [(0, "\n".join(a)), (1, "\n".join(b)), (2, "\n".join(rng.sample(a + b, 65))), (3, "")]
    v = {r["doc_id"]: r["fingerprint"] for r in multiset_hash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    df = spark.createDataFrame([(v[0], v[1], v[2])], "a array<long>, b array<long>, c array<long>")
    got = df.select(multiset_hash.plus(F.col("a"), F.col("b")).alias("sum"), multiset_hash.minus(F.col("c"), F.col("b")).alias("rest"), multiset_hash.minus(F.col("c"), F.col("c")).alias("none")).first()
    assert got["sum"] == v[2] and got["rest"] == v[0] and got["none"] == v[3]


def test_lanes_wrap_by_themselves(spark):
    top = (1 << 30) - 1
    df = spark.createDataFrame([([top << 30 | top, 5], [1 << 30 | 1, 7])], "a array<long>, b array<long>")
    got = df.select(multiset_hash.plus(F.col("a"), F.col("b")).alias("s"), multiset_hash.minus(F.col("b"), F.col("a")).alias("d")).first()
    assert got["s"] == [0, 12] and got["d"] == [2 << 30 | 2, 2]


def test_edits(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], "doc_id long, text string, key string, copies int, id string")
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in multiset_hash.edits(docs).collect())
    want = Counter((a[0], len(a[1] or ""), hashlib.sha256(edited(a[1] or "", b[1] or "").encode()).hexdigest()) for a, b in chain(texts))
    assert got == want


def test_edited_fingerprint_is_that_of_the_edited_text(spark, texts):
    rows = [(i, t) for i, (_, t) in enumerate(texts)]
    told = {r["doc_id"]: r for r in multiset_hash.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    after = {a[0]: edited(a[1] or "", b[1] or "") for a, b in chain(rows)}
    direct = {r["doc_id"]: r["fingerprint"] for r in multiset_hash.fingerprints(spark.createDataFrame(list(after.items()), "doc_id long, text string")).collect()}
    beyond = {a[0]: b[1] for a, b in chain(rows)}

    def cosine(x, y):
        size = math.sqrt(sum(c * c for c in x.values()) * sum(c * c for c in y.values()))
        return sum(c * y[p] for p, c in x.items()) / size if size else float(x == y)

    for i, t in rows:
        assert told[i]["edited_vector"] == direct[i]
        for name, other in (("near_edited", after[i]), ("near_next", beyond[i])):
            assert 0 <= told[i][name] <= 1
            assert abs(told[i][name] - cosine(split(t), split(other))) < 0.4
            assert split(t) != split(other) or told[i][name] == 1


def test_edits_of_one_and_no_document(spark):
    one = multiset_hash.edits(spark.createDataFrame([(7, "a. b. c. d.")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(7, 1.0)]
    assert multiset_hash.edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def phrases(rows, support, longest, most, inside):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    often = {k: a for k, a in counts.items() if a >= support}
    out = []
    for lang in total:
        rows = []
        for (l, w), a in often.items():
            if l != lang or len(w) < 2:
                continue
            if any(x == lang and len(o) > len(w) and 100 * b >= inside * a and any(o[i : i + len(w)] == w for i in range(len(o))) for (x, o), b in often.items()):
                continue
            score, k = min((10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes,longest", [(1 << 20, 3), (3000, 3), (3000, 5)])
def test_collocations(spark, monkeypatch, shard_bytes, longest):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(collocations, "BUCKET_FINDS", 1000)
    monkeypatch.setattr(collocations, "SLAB_BYTES", 700)
    rng = random.Random(2)
    words = ["the", "THE", "a", "é", "of", "x", "New", "york", "city", "b-c", "\U0001f600"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", "\t", ".", "  "]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und"])) for _ in range(150)]
    rows += [("New York City is New York City\nnew york city", "en")] * 12 + [(None, "en"), ("", None), ("., ;!\n", "fr"), ("one " * 3000, "hot"), ("new york city " * 2000, "hot")]
    docs = spark.createDataFrame([(i if i % 9 else None, t, l, "k", 3) for i, (t, l) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")
    got = collocations.collocations(docs, support=4, longest=longest, most=25).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, 4, longest, 25, 50)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, " \n", "en")], "doc_id long, text string, lang string")).collect() == []


def test_words_with_equal_hashes_are_told_apart():
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    words = collocations.Words(data, np.array([0, len(data)]))
    words.hash = np.zeros(4, np.uint64)
    assert words.ids().tolist() == [0, 1, 0, 2]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SLAB_BYTES", 10)
    texts = ["one two, three four five six seven. eight", "", "nine", "x" * 50, "a b.c d"]
    got = [data.tobytes()[a:b] for data, at in collocations.slabs(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    assert b"".join(got) == "".join(texts).encode()
    assert b". eight" in got and b"x" * 50 in got


def coded(rows, dimension, rounds=4):
    """Codes, errors and digest by loops over all entries."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = dimension // 4
    books = [[r[2][p * size : (p + 1) * size] for r in kept[:256]] for p in range(4)]

    def near(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            of = defaultdict(list)
            for _, _, v in kept:
                of[near(p, v[p * size : (p + 1) * size])[1]].append(v[p * size : (p + 1) * size])
            for e, vs in of.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out, errors = [], Counter()
    for i, lab, v in kept:
        found = [near(p, v[p * size : (p + 1) * size]) for p in range(4)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        errors[lab] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, d, errors[lab], digest) for i, lab, c, d in out)


VECTORS = "vec_id long, label int, embedding array<float>, row long, part string"


@pytest.mark.parametrize("scale", [1.0, 40_000.0])
def test_vector_codes(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 8))
    rows = [(i, int(i % 3) if i % 5 else None, [float(np.float32(x * scale)) for x in centers[i % 20] + 0.05 * rng.normal(size=8)]) for i in range(330)]
    rows += [(400 + i, 1, rows[0][2]) for i in range(60)] + [rows[3], rows[3], (None, None, rows[5][2])]
    rows += [(500, 1, None), (501, 1, [1.0, None] + [0.0] * 6), (502, 1, [float("nan")] + [0.0] * 7), (503, 1, [float("-inf")] + [0.0] * 7), (504, 2, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    got = Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.encode(df).collect())
    assert got == coded(rows, 8)


def test_vector_codes_of_few_odd_and_no_vectors(spark):
    few = [(2, 1, [0.5, -0.5, 0.25, 1.0]), (1, None, [0.0, 0.0, 0.0, -0.001])]
    odd = [(9, 1, [1.0, 2.0]), (10, 1, [3e38, 0.0, 0.0, 0.0]), (11, 1, [])]
    got = Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.encode(spark.createDataFrame([(*r, 1, "x") for r in few + odd], VECTORS)).collect())
    assert got == coded(few, 4)
    assert vector_codes.encode(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.encode(spark.createDataFrame([(1, 1, None, 1, "x")], VECTORS)).collect() == []


def test_boxes_rule_out_no_nearest_entry():
    rng = np.random.default_rng(8)
    for _ in range(30):
        points, book = rng.integers(-50, 50, (40, 3)), rng.integers(-60, 60, (30, 3))
        listed = vector_codes.shortlists(points.min(0)[None], points.max(0)[None], book)[0]
        d = ((points[:, None] - book[None]) ** 2).sum(2)
        best, error = vector_codes.nearest(points, book)
        assert listed[best].all() and (best == d.argmin(1)).all() and (error == d.min(1)).all()


def test_curve_visits_neighbours():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    place = vector_codes.curve_places(grid, np.array([0, 0]), np.array([16, 16]))
    walk = grid[np.argsort(place)]
    assert len(set(place.tolist())) == 256 and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_registered_queries(spark):
    docs = spark.createDataFrame(corpus(seed=9, docs=20), SCHEMA)
    got = queries.op11(SimpleNamespace(documents=docs, spark=spark))
    assert got.columns == ["doc_id", "n_chars"] + ["edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = got.collect()
    assert len(rows) == docs.count() and {len(r["fingerprint"]) for r in rows} == {15 + 16 * 8 + 60 * 15}
    assert queries.op12(SimpleNamespace(documents=docs, spark=spark)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    vectors = spark.createDataFrame([(i, 0, [float(i), 1.0, 2.0, 3.0], 1, "x") for i in range(5)], VECTORS)
    assert queries.op13(SimpleNamespace(embeddings=vectors, spark=spark)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
