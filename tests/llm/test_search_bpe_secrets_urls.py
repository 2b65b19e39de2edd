import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marketloom.llm import merge_replay, multiprobe, queries, secrets, url_rules

from .data import SCHEMA, corpus

VECTORS = "vec_id long, embedding array<float>, label int, v string, id string"


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v], 0, "x", "y") for i, v in enumerate(rng.standard_normal((n, dim)).astype(np.float32))]
    rows[7] = (7, rows[8][1], 0, "x", "y")  # ties
    return rows


def nearest(rows, k):
    ok = [(r[0], np.array(r[1], np.float64)) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    out = {}
    for q, v in ok:
        if q % 10 == 0:
            out[q] = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in ok if i != q)[:k]
    return out


def test_recall_and_scores_of_the_search(spark):
    rows = vectors(1, 3000) + [(9001, None, 0, "", ""), (9010, [0.0] * 16, 0, "", ""), (9020, [float("nan")] * 16, 0, "", ""), (9030, [None] * 16, 0, "", ""), (9040, [1.0], 0, "", ""), (None, [1.0] * 16, 0, "", "")]
    got = defaultdict(list)
    for r in multiprobe.nearest_neighbours(spark.createDataFrame(rows, VECTORS), "id % 10 = 0").collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    want = nearest(rows[:3000], 10)
    assert set(got) == set(want)
    hit = 0
    by_id = {r[0]: np.array(r[1], np.float64) for r in rows[:3000]}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        assert all(s == pytest.approx(float(np.sqrt(((by_id[i] - by_id[q]) ** 2).sum())), abs=1e-12) for _, s, i in found)
        hit += len({i for _, _, i in found} & {i for _, i in want[q]})
    assert hit / (10 * len(want)) >= 0.9


def test_few_vectors_give_all_candidates(spark):
    rows = vectors(2, 10)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in multiprobe.nearest_neighbours(spark.createDataFrame(rows, VECTORS), "id % 10 = 0").collect())
    assert got == [(0, n + 1, i) for n, (_, i) in enumerate(nearest(rows, 10)[0])]
    assert multiprobe.nearest_neighbours(spark.createDataFrame([], VECTORS), "id % 10 = 0").collect() == []


def test_probing_order_starts_at_home_and_never_crosses_both_walls():
    order = multiprobe.probing_order(4, 100)
    assert not order[0].any() and len({tuple(r) for r in order.tolist()}) == len(order) <= 81
    assert all(not (r[i] and r[7 - i]) for r in order.tolist() for i in range(4))


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_to_the_text(spark):
    rng = random.Random(4)
    hard = ["a" * 300, "abab" * 50, "<|endoftext|> x", "Ünïcödé — ça va? 字符 🙂🙂", " \n\n  \t x  ", "don't we'll I'M", "\x00\x01", "1234567890" * 30, "é" * 40, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000))]
    rows = corpus(8) + [(900 + i, t, *corpus()[0][2:]) for i, t in enumerate(hard)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("key", "decoded")
    vocabulary = queries.vocabulary()
    told = merge_replay.decode(merge_replay.encode(df, vocabulary, public_tokenizers.PATTERN), vocabulary, "ids", "bytes").collect()
    of, by = encoder(), {r[0]: r[1] or "" for r in rows}
    assert len(told) == len(rows)
    for r in told:
        text = by[r["doc_id"]]
        assert r["ids"] == of.encode_ordinary(text) and bytes(r["bytes"]) == text.encode()
    for r in merge_replay.digests(df, vocabulary, public_tokenizers.PATTERN).collect():
        ids = of.encode_ordinary(by[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(by[r["doc_id"]].encode()).hexdigest()
    assert merge_replay.digests(spark.createDataFrame([], SCHEMA), vocabulary, public_tokenizers.PATTERN).collect() == []


def test_replay_of_all_tokens_and_random_bytes():
    vocabulary = queries.vocabulary()
    rng = random.Random(1)
    pieces = [t for t in vocabulary.tokens if len(t) > 1][::37] + [bytes(rng.choice(b"abcde ") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    ids, counts = merge_replay.replay(vocabulary, pieces)
    of, at = encoder(), 0
    for piece, n in zip(pieces, counts.tolist()):
        own = ids[at : at + n].tolist()
        at += n
        if piece not in vocabulary.ids:
            assert own == of._encode_single_piece(piece)
        assert b"".join(vocabulary.tokens[i] for i in own) == piece


def spans_by_hand(text):
    out = []
    for number, (kind, pattern, group, least) in enumerate((("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if kind == "assign" else 0):
            if len(m[group]) >= least:
                out.append((m.start(), number, kind, m.end()))
    return sorted(out)


SECRETS = [
    "password=token:abcdefgh", "PassWord = 'hunter22' and é🙂 secret:\"x1y2z3\" api_key==abcdef", "token=abc token=abcdef", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 15, "AKIA" * 6,
    "0123456789abcdef01234567 " * 3, "secret=" + "0123456789abcdef" * 2, "f" * 23 + "g" + "f" * 24, "password=password=secret=abcdef", "apikey : " + "Q" * 50, "", None, "🙂" * 10 + "passwd:abc.def=", "token=token=token",
]


def secret_rows():
    return [(i, t, "x", "s", 0, "r", 1, "k", 2, 3) for i, t in enumerate(SECRETS + SECRETS[:4] + [r[1] for r in corpus(3)])]


def test_spans_equal_regular_expressions(spark):
    rows = secret_rows() + [(None, "token=abcdef", "x", "s", 0, "r", 1, "k", 2, 3)]
    got = sorted(((r["doc_id"], [tuple(f) for f in r["findings"]]) for r in secrets.scan_history(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted(((r[0], spans_by_hand(r[1] or "")) for r in rows), key=repr)
    assert secrets.scan_history(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ledger_scans_only_unseen_blobs_and_rule_versions(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = secret_rows()
    first, both = spark.createDataFrame(rows[:8], SCHEMA), spark.createDataFrame(rows, SCHEMA)
    secrets.scan_history(first, ledger_path=path).collect()
    before = {r["blob"] for r in spark.read.parquet(path).collect()}
    told = secrets.scan_history(both, ledger_path=path).collect()
    ledger = spark.read.parquet(path)
    assert ledger.count() == ledger.select("blob").distinct().count() == len({r[1] or "" for r in rows}) > len(before)
    assert all([tuple(f) for f in r["findings"]] == spans_by_hand(rows[r["doc_id"]][1] or "") for r in told)
    newer = tuple(secrets.Rule(r.kind, r.pattern if r.kind != "hex" else "[0-9a-f]{30,}", r.least, r.group, 1 + (r.kind == "hex")) for r in secrets.RULES)
    told = secrets.scan_history(both, rules=newer, ledger_path=path).collect()
    added = spark.read.parquet(path).filter("array_contains(scanned, 'hex/2')").collect()
    assert len(added) == len({r[1] or "" for r in rows}) and all(r["scanned"] == ["hex/2"] for r in added)
    for r in told:
        want = [f for f in spans_by_hand(rows[r["doc_id"]][1] or "") if f[2] != "hex" or f[3] - f[0] >= 30]
        assert [tuple(f) for f in r["findings"]] == want
    again = spark.read.parquet(path).count()
    secrets.scan_history(both, rules=newer, ledger_path=path).collect()
    assert spark.read.parquet(path).count() == again


def rule_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(r, v) for r, v in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=lambda x: len(x[0]), default=(None, None))


def urls():
    rng = random.Random(6)
    rows = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.NET/EN/1", "https://example.net/en/?q=1", "https://notexample.net/en/", "https://ÉXAMPLE.com/de/", "https://a.example.com?x=/de/", "https://b.example.com#/de/", "http://net", "http://net/", "http://x.org/fr/1://y.net/", "http://example.com/de", "a://b.c.example.com/de/5"]
    for _ in range(300):
        rows.append(f"https://{rng.choice(['www.', 'm.', 'cheap-pills.', ''])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(999)}{rng.choice(['', '/', '.html', '?page=2&ref=x', '#top'])}")
    return [(i, u, "h", "hh", "pp", 1.0) for i, u in enumerate(rows)]


def test_given_rules_equal_python(spark):
    rows = urls() + [urls()[20]] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, tokens string, confidence double")
    out = url_rules.judge(df, queries.URL_RULES).collect()
    assert len(out) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in out:
        host, path, (rule, verdict) = rule_by_hand(by[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_rules.judge(df.limit(0), queries.URL_RULES).collect() == []


def test_mined_rules_equal_counting(spark):
    rows = [(u[1], None if not rule_by_hand(u[1])[2][0] else rule_by_hand(u[1])[2][1]) for u in urls()]
    df = spark.createDataFrame(rows, "url string, label string")
    sets = [(frozenset(r["t"]), r["label"]) for r in df.select(url_rules.url_tokens(df["url"]).alias("t"), "label").collect()]
    sets = [s for s in sets if s[0] or s[1]]
    mined = url_rules.mine(df, min_support=0.02, min_confidence=0.8).collect()
    assert mined
    for r in mined:
        have = [label for tokens, label in sets if set(r["tokens"]) <= tokens]
        assert r["confidence"] == pytest.approx(have.count(r["label"]) / len(have)) and r["confidence"] >= 0.8
        assert r["support"] == pytest.approx(have.count(r["label"]) / len(sets)) and r["rarest"] in r["tokens"]
    told = {(frozenset(r["tokens"]), r["label"]): r["confidence"] for r in mined}
    assert not any(a < b and x == y and told[a, x] >= told[b, y] for a, x in told for b, y in told)
    for row in url_rules.match(df, spark.createDataFrame(mined)).collect():
        fit = [r for r in mined if set(r["tokens"]) <= set(row["tokens"])]
        assert row["mined"]["confidence"] == max(r["confidence"] for r in fit)
