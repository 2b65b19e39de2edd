"""Very long texts end; workers need no copy of the package."""

import os
import random
import subprocess
import sys
import tempfile
import time

import public_tokenizers
import regex
import tiktoken

from marketloom.llm import merge_replay, queries, toxicity


def library():
    vocabulary = queries.vocabulary()
    return vocabulary, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})


def test_long_pieces_end(monkeypatch):
    vocabulary, encoding = library()
    for text in ("an" * 500_000, "a" * 300_000, "thethere" * 40_000):
        began = time.time()
        assert len(regex.findall(public_tokenizers.PATTERN, text)) == 1
        ids, counts = merge_replay.replay(vocabulary, [text.encode()])
        assert time.time() - began < 90 and counts.tolist() == [len(ids)]
        assert b"".join(vocabulary.tokens[i] for i in ids.tolist()) == text.encode()
        short = text[:20_000]
        assert merge_replay.replay(vocabulary, [short.encode()])[0].tolist() == encoding.encode_ordinary(short)
        monkeypatch.setattr(merge_replay, "LONG_PIECE", 1 << 30)
        assert merge_replay.replay(vocabulary, [short.encode()])[0].tolist() == encoding.encode_ordinary(short)
        monkeypatch.undo()


def test_replay_equals_the_library_on_random_letters(monkeypatch):
    vocabulary, encoding = library()
    rng = random.Random(6)
    pieces = ["".join(rng.choice(["a", "n", "in", "the", "er", "é", "ß", "tion", "x"]) for _ in range(rng.randrange(1, 120))) for _ in range(600)]
    want = [encoding._encode_single_piece(p.encode()) for p in pieces]
    for long_piece in (8_192, 20):
        monkeypatch.setattr(merge_replay, "LONG_PIECE", long_piece)
        ids, counts = merge_replay.replay(vocabulary, [p.encode() for p in pieces])
        at = [0, *counts.cumsum().tolist()]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert not vocabulary.settled.all()


def test_many_hits_in_one_text():
    model = toxicity.ToxicityModel(lexicon={"bad": 1.0, "awful": 2.0}, exceptions={"not bad"})
    automaton = toxicity._automaton(model)
    text = " " + "bad not bad awful " * 60_000
    began = time.time()
    found = toxicity.hits(automaton, text)
    assert time.time() - began < 20
    assert len(found) == 120_000 and sum(w for _, _, w in found) == 180_000


WORKER = """
import os, sys, tempfile
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="marketloom-tests-")).getOrCreate()
from types import SimpleNamespace
from marketloom.llm import language, merge_replay, queries, toxicity, collocations, multiset_hash, vector_codes
import public_tokenizers
def missing(_):
    import importlib.util
    yield importlib.util.find_spec("marketloom") is None
assert spark.sparkContext.parallelize([1], 1).mapPartitions(missing).collect() == [True], "workers see the package"
docs = spark.createDataFrame([(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * 5 + str(i), "en" if i % 2 else "fr", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
vectors = spark.createDataFrame([(i, 0, [float(i), 1.0, 2.0, 3.0]) for i in range(9)], "vec_id long, label int, embedding array<float>")
tables = SimpleNamespace(documents=docs, labels=labels, embeddings=vectors, spark=spark)
for name in ("op2", "op3", "op8", "op12", "op13"):
    assert len(getattr(queries, name)(tables).collect()) >= 0, name
print("SHIPPED")
"""


def test_workers_without_the_package():
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", WORKER.format(repo=repo)], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=600)
    assert "SHIPPED" in done.stdout, done.stderr[-1500:]
