import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from marketloom.functions.similarity import TextBlock, _lcs_length, partial_ratio
from marketloom.operators import matching, vectors

from .conftest import rows


def slow_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def slow_ratio(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0

    def best(short, long):
        m, n = len(short), len(long)
        cuts = [long[max(s, 0) : min(s + m, n)] for s in range(1 - m, n)]
        return max(200.0 * slow_lcs(short, w) / (m + len(w)) for w in cuts if w)

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def test_partial_ratio_against_definition():
    random.seed(3)
    words = ["".join(random.choice("ab c") for _ in range(random.randint(0, 14))) for _ in range(60)]
    block = TextBlock(words)
    for needle in [*words[:15], "", "abcabcabcabcabcabc", "x" * 70]:
        got = block.partial_ratios(needle)
        for text, value in zip(words, got):
            assert value == pytest.approx(slow_ratio(needle, text))
            assert partial_ratio(needle, text) == pytest.approx(value)
    assert _lcs_length("abcde", "xbxdx") == 2


def _letters(draw, alphabet, low, high):
    return "".join(draw.choice(alphabet) for _ in range(draw.randint(low, high)))


@pytest.mark.parametrize("alphabet", ["ab ", "abcdefghij é😀"])
def test_best_of_block_loses_nothing_to_its_bound(alphabet):
    draw = random.Random(5)
    for _ in range(12):
        texts = [*(_letters(draw, alphabet, 0, 30) for _ in range(25)), "", "x" * 70]
        candidates = [*(_letters(draw, alphabet, 0, 12) for _ in range(8)), "", _letters(draw, alphabet, 66, 70)]
        truth = np.array([[slow_ratio(c, t) for c in candidates] for t in texts])
        block = TextBlock(texts)
        for j, candidate in enumerate(candidates):
            assert (block.bounds(candidate) + 1e-9 >= truth[:, j]).all()
        for n, threshold in [(1, 0), (1, 85), (3, 60)]:
            top, pick = matching.best_of_block(block, candidates, n, threshold)
            for i in range(len(texts)):
                order = sorted(range(len(candidates)), key=lambda j: (-truth[i, j], j))
                want = [j for j in order if truth[i, j] >= threshold][:n]
                assert [int(j) for s, j in zip(top[i], pick[i]) if j >= 0 and s >= threshold] == want


def test_few_pairs_are_scored():
    draw = random.Random(6)
    words = [_letters(draw, "abcdefghijklmnopqrstuvwxyz", 3, 9) for _ in range(200)]
    candidates = [" ".join(draw.sample(words, 2)) for _ in range(200)]
    block = TextBlock([f"2019 {draw.choice(candidates).replace('a', 'e', 1)} {draw.choice(words)} for sale" for _ in range(400)])
    matching.best_of_block(block, candidates, 1, 70)
    assert block.scored < 0.03 * 400 * 200


def _numbered(draw, size):
    parts = [(f"{draw.choice(['steel', 'blue', 'old'])} {draw.choice(['gear', 'wheel', 'bolt'])}", draw.randrange(10**6)) for _ in range(size)]
    return [f"selling {name.replace('e', 'ee')} {number} cheap" for name, number in parts], sorted({f"{name} {number}" for name, number in parts})


def test_candidates_that_share_beginnings_match_exactly():
    texts, candidates = _numbered(random.Random(7), 60)
    candidates = [*candidates, candidates[0], candidates[0][:9], "selling", "cheap", "heap of", "p" * 64]
    truth = np.array([[slow_ratio(c, t) for c in candidates] for t in texts])
    for n, threshold in [(1, 70), (3, 0)]:
        top, pick = matching.best_of_block(TextBlock(texts), candidates, n, threshold)
        for i in range(len(texts)):
            want = [j for j in sorted(range(len(candidates)), key=lambda j: (-truth[i, j], j)) if truth[i, j] >= threshold][:n]
            assert [int(j) for s, j in zip(top[i], pick[i]) if j >= 0 and s >= threshold] == want
            assert [s for s in top[i] if s >= threshold] == [truth[i, j] for j in want]


def test_work_does_not_grow_with_pairs(monkeypatch):
    """Eight times the candidates cost a text less than four times the steps, and no bound is taken of every pair."""
    bounded = []
    monkeypatch.setattr(TextBlock, "bounds", lambda self, candidate, plain=TextBlock.bounds: bounded.append(len(self.texts)) or plain(self, candidate))
    steps = []
    for size in (300, 2400):
        texts, candidates = _numbered(random.Random(8), size)
        block = TextBlock(texts[:100])
        matching.best_of_block(block, candidates, 1, 70)
        steps.append(block.visited)
    assert not bounded and steps[1] < 4 * steps[0]


def test_one_very_long_text_does_not_widen_the_others():
    block = TextBlock(["short one", "y" * 300_000 + "needle", "needles"])
    assert list(block.partial_ratios("needle")) == [pytest.approx(slow_ratio("needle", "short one")), 100.0, 100.0]


def test_partial_ratio_examples():
    assert partial_ratio("trek", "2020 trek slash") == 100.0
    assert partial_ratio("", "x") == 0.0


CATALOGUE = [("2018", "trek", "slash 9"), ("2018", "trek", "fuel ex"), ("2018", "santa cruz", "nomad"), ("2018", "treck", "slash 9"), ("2019", "trek", "remedy")]


def naive_match(year, title, n, maker_min, model_min):
    entries = [e for e in CATALOGUE if e[0] == year]
    makers = sorted({m for _, m, _ in entries})
    if not makers or not title:
        return []
    best = max(makers, key=lambda m: (slow_ratio(m, title), -makers.index(m)))
    if slow_ratio(best, title) < maker_min:
        return []
    models = sorted((-slow_ratio(d, title), d) for _, m, d in entries if m == best)[:n]
    return [(year, title, best, d) for s, d in models if -s >= model_min]


@pytest.mark.parametrize("n", [1, 2])
@pytest.mark.parametrize("slices", [(20_000, 5_000), (2, 1)])
def test_fuzzy_match_against_brute_force(frame, monkeypatch, n, slices):
    monkeypatch.setattr(matching, "TEXTS_PER_SLICE", slices[0])
    monkeypatch.setattr(matching, "CANDIDATES_PER_SLICE", slices[1])
    titles = [("2018", "2018 Trek Slash 9.8"), ("2018", "Santacruz Nomad"), ("2018", "unrelated"), ("2018", ""), ("2017", "Trek"), ("2019", "trek remdy"), ("2018", "trek fuel"), ("2018", "trek fuel")]
    out = matching.fuzzy_match(frame(titles, "year string, ad_title string"), frame(CATALOGUE, "year string, manufacturer string, model string"), n=n)
    expected = sorted({m for y, t in titles for m in naive_match(y, t.lower(), n, 70, 70)})
    assert sorted(rows(out, "match_year", "match_title", "match_maker", "match_model")) == expected


def test_augment_with_specs(frame):
    specs = frame(
        [("https://s/bikes/trek/2018/Slash-9", "about $2,499", "13.25 kg", "160mm front, 150mm rear"), ("https://s/bikes/trek/2018/slash-9", "$1", None, None), ("https://s/none", "$5", None, None)],
        "spec_url string, msrp_summary string, weight_summary string, travel_summary string",
    )
    ads = frame([(1, "2018", "Trek SLASH 9 large"), (2, "2018", "zzz"), (3, None, "Trek"), (4, "2018", "Trek SLASH 9 large")], "id int, year string, ad_title string")
    out = matching.augment_with_specs(ads, matching.spec_catalogue(specs))
    assert rows(out, "id", "fuzzy_match", "msrp_cleaned", "weight_summary", "rear_travel_summary") == [
        (1, "2018 trek slash 9", 2499.0, 13.25, 150.0), (2, None, None, 0.0, 0.0), (3, None, None, 0.0, 0.0), (4, "2018 trek slash 9", 2499.0, 13.25, 150.0),
    ]


def test_spec_urls_are_dealt_out_and_parsed_once_for_a_match(frame, tmp_path, monkeypatch):
    specs = [(f"https://s/bikes/maker{i % 3}/2018/Model-{i}",) for i in range(30)]
    frame(specs, "spec_url string").coalesce(1).write.parquet(f"{tmp_path}/specs")
    catalogue = matching.spec_catalogue(frame([], "id int").sparkSession.read.parquet(f"{tmp_path}/specs"))
    assert "RoundRobinPartitioning" in catalogue._jdf.queryExecution().executedPlan().toString()
    written, plain = [], matching.materialize

    def kept(df, purpose):
        written.append("regexp_extract" in df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, purpose)

    monkeypatch.setattr(matching, "materialize", kept)
    ads = frame([("2018", "maker1 model-4 large")], "year string, ad_title string")
    out = matching.fuzzy_match(ads, catalogue)
    assert [r["match_model"] for r in out.collect()] == ["Model-4"]
    assert sum(written) == 1 and "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()


def brute_neighbours(q, t, k, skip):
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    out = []
    for qi, qv in q:
        ranked = sorted((round(1 - float(unit(qv) @ unit(tv)), 9) + 0.0, ti) for ti, tv in t if not (skip and ti == qi))
        out += [(qi, ti, rank + 1) for rank, (_, ti) in enumerate(ranked[:k])]
    return sorted(out)


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("skip", [True, False])
@pytest.mark.parametrize("slice_rows", [4096, 7])
def test_nearest_against_brute_force(frame, monkeypatch, few, skip, slice_rows):
    monkeypatch.setattr(vectors, "ROWS_PER_SLICE", slice_rows)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    points = np.vstack([centres[i % 4] + 0.2 * rng.normal(size=6) for i in range(90)] + [np.repeat(centres[:1], 12, axis=0)])
    data = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = frame(data, "vec_id long, embedding array<double>")
    q = [(i, np.array(v)) for i, v in data[::3]]
    queries = df.where(F.col("vec_id").isin([i for i, _ in q]))
    out = vectors.nearest(queries, df, 5, skip_same=skip, broadcast_limit=1000 if few else 0)
    got = sorted(tuple(r) for r in out.select("query_id", "neighbour_id", "rank").collect())
    assert got == brute_neighbours(q, [(i, np.array(v)) for i, v in data], 5, skip)


@pytest.mark.parametrize("dense_share", [0.0, 2.0])
@pytest.mark.parametrize("skip", [True, False])
def test_blocks_and_cells_give_the_same_neighbours(frame, monkeypatch, dense_share, skip):
    """Many copies of one vector tie; the blocks and steps are small, so that each meeting is cut several times."""
    for name, size in (("ROWS_PER_BLOCK", 40), ("QUERIES_PER_BLOCK", 16), ("_STEP", 8), ("ROWS_PER_SLICE", 16)):
        monkeypatch.setattr(vectors, name, size)
    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(size=(100, 5)), np.repeat(rng.normal(size=(1, 5)), 20, axis=0)])
    data = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = frame(data, "id long, v array<double>")
    q = [(i, np.array(v)) for i, v in data[::3]]
    out = vectors.nearest_many(df.where("id % 3 = 0"), df, 5, skip, dense_share=dense_share)
    got = sorted(tuple(r) for r in out.select("query_id", "neighbour_id", "rank").collect())
    want = brute_neighbours(q, [(i, np.array(v)) for i, v in data], 5, skip)
    assert got == want
    unit = vectors._unit(points)
    near = vectors._top_pairs(np.arange(0, 120, 3), unit[::3], np.arange(120)[::-1], unit[::-1], 5, skip)  # in steps of 8
    near["rank"] = near.groupby("query_id").cumcount() + 1
    assert sorted(near[["query_id", "neighbour_id", "rank"]].itertuples(index=False, name=None)) == want


def test_random_directions_meet_in_blocks(frame, monkeypatch):
    """Cells rule out next to nothing there, and no query is copied to them."""
    purposes = []
    monkeypatch.setattr(vectors, "materialize", lambda df, purpose: purposes.append(purpose) or df.localCheckpoint())
    rng = np.random.default_rng(2)
    df = frame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 16)))], "id long, v array<double>")
    assert vectors.nearest_many(df, df, 3, True).count() == 600 and "visits" not in purposes


@pytest.mark.parametrize("name", ["j16_nearest_vectors", "j16_nearest_vectors_many"])
def test_every_vector_asks_for_its_neighbours(frame, spark, tmp_path, name):
    """Also those of odd, negative or repeated ids; the SQL says the same."""
    rng = np.random.default_rng(4)
    ids = [-7, 1, 19, 20, 21, 40, *range(101, 130), 20]
    data = [(i, [float(x) for x in v]) for i, v in zip(ids, rng.normal(size=(len(ids), 8)).astype(np.float32))]
    frame(data, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = entry_module.queries()[name](spark, str(tmp_path)).select("query_id", "neighbour_id", "distance", "rank").collect()
    assert {r.query_id for r in got} == set(ids) and len(got) == 30 * len(set(ids))
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(entry_module.oracle_sql()[name]).fetchall()
    assert sorted((r.query_id, r.rank, r.neighbour_id) for r in got) == sorted((q, rank, n) for q, n, _, rank in want)
    assert sorted(r.distance for r in got) == pytest.approx(sorted(d for *_, d, _ in want), abs=2e-6)
