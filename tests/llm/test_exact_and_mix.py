import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from marketloom.llm import fingerprints as fp
from marketloom.llm import mixing

from .data import SCHEMA, corpus


def test_fingerprints_compose():
    rng = random.Random(3)
    for n, m in [(0, 5), (5, 0), (1023, 1025), (1024, 1024), (5000, 70_001)]:
        a, b = ("".join(rng.choice("abc\x00é") for _ in range(k)) for k in (n, m))
        one, two, both = fp.fingerprints(pa.array([a, b, a + b])).to_pylist()
        assert fp.combine(one, two, len(b.encode())) == both
    plain = 0
    for byte in b"hello \xc3\xa9":
        plain = (plain * fp.BASES[0] + byte) % fp.PRIMES[0]
    assert fp.fingerprints(pa.array(["hello é"])).to_pylist()[0] >> 31 == plain


def groups_by_hand(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    return by


def test_exact_groups_against_a_dictionary(spark):
    rows = corpus()
    by = groups_by_hand(rows)
    got = {r["doc_id"]: r for r in fp.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = by[r[1] or ""]
        told = got[r[0]]
        assert (told["keep_id"], told["group_size"], told["kept"]) == (max(own), len(own), r[0] == max(own))
        assert told["text_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()


def test_exact_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    rows = corpus()
    rows += [rows[3], rows[3], (None, "null id", *rows[0][2:]), (None, "null id", *rows[0][2:]), (None, rows[5][1], *rows[0][2:])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = fp.exact_dedup(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert Counter(r["text"] or "" for r in kept) == Counter({t: 1 for t in groups_by_hand(rows)})
    assert all(r["doc_id"] == max((i for i in groups_by_hand(rows)[r["text"] or ""] if i is not None), default=None) for r in kept)
    assert sum(r["kept"] for r in fp.exact_groups(df).collect()) == len(kept)


def test_exact_dedup_fetches_its_rows_without_another_pass_through_python(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/docs")
    out = fp.exact_dedup(spark.read.parquet(f"{tmp_path}/docs"))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(r["text"] or "" for r in out.collect()) == Counter({t: 1 for t in groups_by_hand(corpus())})


def test_chunks_of_repeated_keys_are_hashed_once(spark):
    marked = fp.with_fingerprint(spark.createDataFrame(corpus(), SCHEMA).select("text"))
    keys = spark.createDataFrame([(0, 0)], "_fp long, _bytes long")
    assert fp.differing(marked, keys)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_a_slab_of_short_texts_is_hashed_like_single_texts():
    texts = ["", "a" * 3 * fp.SLAB_BYTES, *(f"t{i}" for i in range(3000)), "é" * fp.SLAB_BYTES, None]
    assert fp.fingerprints(pa.array(texts)).to_pylist() == [fp.fingerprints(pa.array([t], pa.string())).to_pylist()[0] for t in texts]


def test_unequal_texts_under_one_fingerprint_are_told_apart(spark):
    rows = [(1, 7, 2, "ab"), (2, 7, 2, "ab"), (3, 8, 2, "ab"), (4, 8, 2, "ba"), (5, 9, 70000, "a" * 70000), (6, 9, 70000, "a" * 69999 + "b")]
    marked = spark.createDataFrame(rows, "doc_id long, _fp long, _bytes long, text string")
    assert {r["_fp"] for r in fp.differing(marked, marked.select("_fp", "_bytes").distinct()).collect()} == {8, 9}


@pytest.mark.parametrize("work", [fp.exact_groups, fp.exact_dedup, mixing.mix, mixing.mixed])
def test_empty_tables(spark, work):
    assert work(spark.createDataFrame([], SCHEMA)).collect() == []


def mix_by_hand(rows):
    """Targets by resharing round after round, then whole documents in key order."""
    size = lambda t: len((t or "").replace("\n", " ").replace("\t", " ").split(" ")) - (t or "").replace("\n", " ").replace("\t", " ").split(" ").count("")
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0], size(r[1])))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = {s: sum(n for _, n in by[s]) for s in names}
    left, free, target = sum(total.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * total[s]
            free.discard(s)
        left = sum(total.values()) - sum(target.values())
    return by, total, target


def test_mix_against_resharing_by_hand(spark):
    rows = corpus()
    by, total, target = mix_by_hand(rows)
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), range_rows=7).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert (r["doc_id"], r["size"]) in by[r["source"]]
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in target)


def test_mix_does_not_depend_on_ranges_or_partitions(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    rows = lambda x: sorted((r["doc_id"], r["taken"]) for r in x.collect())
    assert rows(mixing.mix(df, range_rows=5)) == rows(mixing.mix(df.repartition(7))) != rows(mixing.mix(df, seed="other"))


def test_mixed_repeats_and_cuts_documents(spark):
    rows = corpus()
    rows += [rows[4]] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
        assert any(x[0] == r["doc_id"] and (x[1] or "").startswith(r["text"]) for x in rows)
    _, _, target = mix_by_hand(rows)
    assert all(words[s] == int(target[s] + 1e-9) for s in target)
