import random

import numpy as np
import pytest

from marketloom.llm import suffixes

from .data import SCHEMA, corpus


def by_brute_force(rows):
    """Removed bytes of each row: windows in the order of (id, start), compared with all at an earlier place."""
    last = float("inf")
    first = {}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 99):
            place = (last if i is None else i, p)
            w = raw[p : p + 100]
            first[w] = min(first.get(w, place), place)
    out = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 99):
            if first[raw[p : p + 100]] < (last if i is None else i, p):
                gone[p : p + 100] = [True] * 100
        out.append((i, len(raw), bytes(b for b, g in zip(raw, gone) if not g), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))))
    return out


@pytest.mark.parametrize("slab", [suffixes.SLAB_BYTES, 3000])
def test_removal_equals_brute_force(spark, monkeypatch, slab):
    monkeypatch.setattr(suffixes, "SLAB_BYTES", slab)
    rows = corpus(5)
    rng = random.Random(9)
    texts = [r[1] for r in rows if r[1]]
    for k in range(30):  # stretches of other texts at odd places, just below and above a window
        a, n = rng.choice(texts), rng.choice([99, 100, 101, 130, 260])
        at = rng.randrange(max(1, len(a) - n))
        rows.append((500 - k, "q" * rng.randrange(3) + a[at : at + n] + rng.choice(["", " end", "yz" * 80]), *rows[0][2:]))
    rows += [(None, rows[1][1], *rows[0][2:]), (None, rows[2][1], *rows[0][2:]), rows[3], (rows[4][0], (rows[4][1] or "") + " tail " + (rows[5][1] or ""), *rows[0][2:])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    told = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got), key=repr)
    assert told == sorted(by_brute_force(rows), key=repr)
    assert all(r["n_bytes"] - len(r["kept"]) == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)


def test_long_texts_go_by_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    rng = random.Random(2)
    base = "".join(rng.choice("abcd ") for _ in range(6000))
    rows = [(1, base, *corpus()[0][2:]), (2, "x" + base[500:4500] + "y" + base[:1200], *corpus()[0][2:])]
    got = {(r["doc_id"], bytes(r["kept"])) for r in suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, kept) for i, _, kept, _ in by_brute_force(rows)}


def common_line(n):
    """Texts that share a line shorter than a window, in different surroundings, some of which agree for a while."""
    rng = random.Random(4)
    noise = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line, near = "one line that very many of the documents hold, all of them", [noise(40) for _ in range(3)]
    texts = [noise(rng.randint(0, 150)) + rng.choice(near)[rng.randrange(41) :] + line + rng.choice(near)[: rng.randrange(41)] + noise(rng.randint(0, 150)) for _ in range(n)]
    return [(i, t, *corpus()[0][2:]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot_rows", [1, 20])
def test_hot_leading_strings_equal_brute_force(spark, hot_rows):
    rows = common_line(200)
    rows += [(300 + r[0], *r[1:]) for r in corpus(5)] + [(None, *rows[1][1:]), rows[3], (rows[4][0], rows[4][1] + rows[5][1], *rows[0][2:]), (900, "\x00" * 90 + "é" * 80 + rows[7][1], *rows[0][2:])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), hot_rows=hot_rows).collect()
    told = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got), key=repr)
    assert told == sorted(by_brute_force(rows), key=repr)


def test_no_slot_gets_all_of_a_hot_leading_string(spark, monkeypatch):
    """The rows that meet in one task, by the exchange's own column."""
    met, plain = [], type(spark.range(0)).repartition

    def watched(frame, *by):
        if "contexts" in frame.columns:
            met.extend(frame.selectExpr("slot", "size(keys) n", "octet_length(contexts) bytes").filter("bytes > 0").groupBy("slot").sum("n").collect())
        return plain(frame, *by)

    monkeypatch.setattr(type(spark.range(0)), "repartition", watched)
    monkeypatch.setattr(suffixes.remove_repeats, "__defaults__", tuple(20 if d == suffixes.HOT else d for d in suffixes.remove_repeats.__defaults__) if hasattr(suffixes, "HOT") else suffixes.remove_repeats.__defaults__)
    suffixes.remove_repeats(spark.createDataFrame(common_line(400), SCHEMA)).count()
    counts = [r[1] for r in met]
    assert sum(counts) > 400 and max(counts) < 0.3 * sum(counts)


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (400, 5)).astype(np.uint64)
    order, run = suffixes.multikey_order(words)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(rows) and [run[i] == run[i - 1] for i in range(1, 400)] == [rows[i] == rows[i - 1] for i in range(1, 400)]


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
