import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp

from .test_join import shingles
from .test_language_toxicity import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    texts = [(prose(rng, lang, rng.randint(40, 120)), lang) for _ in range(60) for lang in ("aa", "bb", "cc")]
    texts += texts[:12]
    for t, lang in texts[20:40]:
        words = t.split()
        words[rng.randrange(len(words))] = words[0]
        texts.append((" ".join(words), lang))
    texts += [(None, "aa"), ("", "bb"), ("12 34 !!", None), (texts[50][0], None)]
    rng.shuffle(texts)
    return [(i, t, lang, None if i % 9 == 0 else f"src{i % 4}", len(t or "")) for i, (t, lang) in enumerate(texts)]


def by_hand(rows):
    """Texts that each of the first three stages leaves, by plain loops."""
    known = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    last = {}
    for r in sorted(known, key=lambda r: r[0]):
        last[r[1]] = r
    single = sorted(last.values())
    sets = {r[0]: shingles(r[1]) for r in single}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return known, single, [r for r in single if label[r[0]] == r[0]]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs
    return folder, out


def test_stages_keep_what_plain_loops_keep(stages):
    _, out = stages
    for name, rows in zip(("language", "exact_dedup", "near_dedup"), by_hand(documents())):
        assert sorted(tuple(r) for r in out[name].collect()) == sorted(rows), name
    assert all(out[name].columns == ["doc_id", "text", "lang", "source", "n_chars"] for name in ("language", "exact_dedup", "near_dedup", "mix"))


def test_mix_takes_each_source_near_its_target(stages):
    _, out = stages
    have, took = Counter(), Counter()
    for r in out["near_dedup"].collect():
        have[r["source"]] += len(r["text"].split())
    for r in out["mix"].collect():
        took[r["source"]] += len(r["text"].split())
    assert all(took[s] <= 3 * have[s] for s in took) and abs(sum(took.values()) - sum(have.values())) <= len(have)


def test_tokens_are_those_of_the_mixed_texts(stages):
    _, out = stages
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    of = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], tuple(of.encode_ordinary(r["text"]))) for r in out["mix"].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out["tokens"].collect()) == want


def test_run_applies_all_stages(spark, stages):
    folder, out = stages
    key = lambda r: (r["doc_id"], r["ids_sha256"])
    assert sorted(map(key, cp.run(spark, folder).collect())) == sorted(map(key, out["tokens"].collect()))


def test_stages_take_empty_tables(spark, stages):
    folder, _ = stages
    empty = spark.createDataFrame([], SCHEMA)
    assert all(stage(spark, empty, folder).collect() == [] for _, stage in cp.STAGES)


def test_foreign_texts_leave_small_tables(spark, stages):
    folder, _ = stages
    foreign = [(1000 + i, "wjqzx xqzjw jwq " * (20 + i), None, "src1", 0) for i in range(3)]
    kept = cp.keep_languages(spark, spark.createDataFrame(documents() + foreign, SCHEMA), folder).collect()
    assert sorted(tuple(r) for r in kept) == sorted(by_hand(documents())[0])
