"""Phrase collocations by SON partitioning.

The documents are dealt into shards by their ids; a unit is the part of a shard in one language. A unit is mined completely: it
finds every phrase of up to the longest length whose local count reaches the support times the unit's share of its
language's bytes. A phrase that reaches the support overall reaches that share in one unit at least, so the union of the
local finds misses none. The union goes back to the units that hold its members; there they are counted exactly, word by
word, and the counts are added up.

Mining works on 48-bit hashes of phrases: a clash can only add a candidate, which the exact count throws out again.
A unit's finds travel as packed blocks by range of the hash, not as rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import MIX, ragged, scramble, utf8
from marketloom.session import materialize

SHARD_BYTES = 16 << 20
SLAB_BYTES = 2 << 20
BUCKET_FINDS = 4_000_000
HELD = 4_000_000  # hashes that a unit holds before it counts them
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 letter, 1 blank, 2 end of a piece
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2

FINDS = "bucket int, lang string, shard int, hashes binary, counts binary, slack long"
UNITS = "shard int, lang string, kind int, text string, hashes binary, least long, slack long"


class Words:
    """Words of some lower-cased texts: first byte, end, number of the piece they are in, and 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        kind = _KIND[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True
        letter = np.r_[False, kind == 0, False]
        self.start = np.flatnonzero(letter[1:-1] & (~letter[:-2] | fresh[:-1]))
        self.end = np.flatnonzero(letter[1:-1] & (~letter[2:] | fresh[1:])) + 1
        self.length = self.end - self.start
        self.piece = np.cumsum(kind == 2)[self.start] + np.searchsorted(offsets, self.start, side="right")
        powers = np.cumprod(np.full(int(self.length.max(initial=0)) + 1, BASE, np.uint64))
        first = np.cumsum(self.length) - self.length
        letters = self.data[letter[1:-1]].astype(np.uint64) + np.uint64(1)
        letters *= powers[np.arange(len(letters)) - np.repeat(first, self.length)]
        self.hash = scramble(np.add.reduceat(letters, first)) if len(first) else np.zeros(0, np.uint64)

    def phrases(self, n: int) -> np.ndarray:
        """Numbers of the words at which a phrase of ``n`` words starts that stays in its piece."""
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1]) if len(self.piece) >= n else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
        """48-bit hashes of the phrases of ``n`` words that start at ``at``."""
        h = np.full(len(at), seed + np.uint64(n), np.uint64)
        for k in range(n):
            h = scramble((h ^ self.hash[at + k]) * MIX)
        return h >> np.uint64(16)

    def ids(self) -> np.ndarray:
        """Number of each word among the different words; equal hashes are compared byte by byte."""
        _, index, ids = np.unique(self.hash, return_index=True, return_inverse=True)
        head = index[ids]
        same = np.array_equal(self.length, self.length[head]) and np.array_equal(self.data[ragged(self.start, self.length)], self.data[ragged(self.start[head], self.length)])
        if same:
            return ids
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.data[s:e].tobytes(), len(known)) for s, e in zip(self.start, self.end)], np.int64)


def slabs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of texts, up to about SLAB_BYTES at a time; a longer text is cut at ends of pieces."""
    data, offsets = utf8(column)
    i, last = 0, len(offsets) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLAB_BYTES, side="right")) - 1)
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
        lo = 0
        while len(part) - lo > SLAB_BYTES:
            ends = np.flatnonzero(_KIND[part[lo + SLAB_BYTES :]] == 2)
            if not len(ends):
                break
            stop = lo + SLAB_BYTES + int(ends[0])
            yield part[lo:stop], np.array([0, stop - lo])
            lo = stop
        if lo < len(part):
            yield part[lo:], np.array([0, len(part) - lo]) if lo else own


def _seed(lang: str) -> np.uint64:
    h = 0
    for b in lang.encode():
        h = (h * 1099511628211 + b + 1) & (1 << 64) - 1
    return scramble(np.array([h], np.uint64))[0]


def pack(hashes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 48-bit hashes as differences, and counts, both as planes of bytes, most of which are zero."""
    planes = lambda x, n: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()
    return planes(np.diff(hashes, prepend=np.uint64(0)), 6), planes(counts, 5)


def unpack(data: bytes, planes: int) -> np.ndarray:
    wide = np.zeros((len(data) // planes, 8), np.uint8)
    wide[:, :planes] = np.frombuffer(data, np.uint8).reshape(planes, -1).T
    return wide.reshape(-1).view("<u8")


class _Miner:
    """Counts all phrases of a unit and gives those that reach the local support, by range of their hashes."""

    def __init__(self, shard: int, lang: str, longest: int, buckets: int):
        self.shard, self.lang, self.longest, self.buckets = shard, lang, longest, buckets
        self.least, self.slack, self.seed = 1, 0, _seed(lang)
        self.fresh: list[np.ndarray] = []
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def head(self, row: dict) -> None:
        self.least, self.slack = row["least"], row["slack"]

    def add(self, texts: pa.Array) -> None:
        for data, offsets in slabs(texts):
            words = Words(data, offsets)
            self.fresh += [words.hashes(words.phrases(n), n, self.seed) for n in range(1, self.longest + 1)]
            if sum(map(len, self.fresh)) > HELD:
                self._settle()

    def _settle(self) -> None:
        if self.fresh:
            hashes, counts = np.unique(np.concatenate(self.fresh), return_counts=True)
            self.fresh = []
            self.hashes, self.counts = _added(np.concatenate([self.hashes, hashes]), np.concatenate([self.counts, counts])) if len(self.hashes) else (hashes, counts)

    def rows(self) -> Iterator[tuple]:
        self._settle()
        often = self.counts >= self.least
        hashes, counts = self.hashes[often], self.counts[often]
        cuts = np.searchsorted(hashes, np.array([(b << 48) // self.buckets for b in range(1, self.buckets)], np.uint64))
        for b, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(counts, cuts))):
            if len(h):
                yield (b, self.lang, self.shard, *pack(h, c), self.slack)


def _added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[first], np.add.reduceat(counts[order], first)


class _Counter:
    """Counts the candidates of a unit word by word; also its words."""

    def __init__(self, shard: int, lang: str, longest: int, buckets: int):
        self.lang, self.longest, self.seed = lang, longest, _seed(lang)
        self.blocks: list[np.ndarray] = []
        self.known: np.ndarray | None = None
        self.counts = [Counter() for _ in range(longest + 1)]

    def head(self, row: dict) -> None:
        self.blocks.append(np.cumsum(unpack(row["hashes"], 6)))

    def add(self, texts: pa.Array) -> None:
        if self.known is None:
            self.known = np.sort(np.concatenate([*self.blocks, np.zeros(0, np.uint64)]))
        for data, offsets in slabs(texts):
            words = Words(data, offsets)
            self.counts[0][""] += len(words.start)
            ids = words.ids()
            size = int(ids.max(initial=0)) + 1
            for n in range(1, self.longest + 1):
                at = words.phrases(n)
                h = words.hashes(at, n, self.seed)
                if not len(h) or not len(self.known):
                    continue
                at = at[self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h]
                key, most = ids[at], size
                for k in range(1, n):
                    if most * size >= 1 << 62:
                        different, key = np.unique(key, return_inverse=True)
                        most = len(different)
                    key, most = key * size + ids[at + k], most * size
                _, index, counts = np.unique(key, return_index=True, return_counts=True)
                own = words.data.tobytes()
                first = at[index]
                spans = [(words.start[first + k].tolist(), words.end[first + k].tolist()) for k in range(n)]
                held = self.counts[n]
                for i, c in enumerate(counts.tolist()):
                    held[b" ".join([own[s[i] : e[i]] for s, e in spans])] += c

    def rows(self) -> Iterator[tuple]:
        for n, held in enumerate(self.counts):
            for phrase, c in held.items():
                yield self.lang, n, phrase.decode() if n else "", c


def _by_unit(kind: type, schema: pa.Schema, longest: int, buckets: int):
    """Task function over rows in the order of shard, language and kind: heads of a unit before its texts."""

    def flushed(unit) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in unit.rows():
            rows.append(row)
            if len(rows) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, of = None, None
        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist(), batch.column("kind").to_pylist()))
            i = 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i][:2] != of:
                    if unit:
                        yield from flushed(unit)
                    of = keys[i][:2]
                    unit = kind(*of, longest, buckets)
                if keys[i][2] == 0:
                    for row in batch.slice(i, j - i).to_pylist():
                        unit.head(row)
                else:
                    unit.add(batch.column("text").slice(i, j - i))
                i = j
        if unit:
            yield from flushed(unit)

    return run


def _united(support: int):
    """Group function over the blocks of a range of hashes: the finds that may reach the support, as blocks of the same units."""
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("hashes", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["lang", "shard", "hashes", "counts", "slack"]).to_pylist()
        own = [np.cumsum(unpack(r["hashes"], 6)) for r in rows]
        counts = [unpack(r["counts"], 5).astype(np.int64) for r in rows]
        hashes, total = _added(np.concatenate(own), np.concatenate(counts))
        out = []
        for r, h in zip(rows, own):
            keep = h[total[np.searchsorted(hashes, h)] + r["slack"] >= support]
            if len(keep):
                out.append((r["shard"], r["lang"], pack(keep, np.zeros(0, np.int64))[0]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, n): phrases of 1 to ``longest`` words that occur ``support`` times or more in their language.

    A row with words 0 and an empty phrase has all words of the language. A-Z is lower-cased; phrases stay inside
    pieces between ``.,;:!?`` and line breaks; occurrences that overlap all count. Null texts are empty, null languages
    are ``und``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), text.alias("text")).filter("text != ''")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / SHARD_BYTES))
    buckets = max(1, math.ceil(size * longest / 6 / BUCKET_FINDS))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = named.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "lang", "text")
    units = laid.groupBy("shard", "lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    units = materialize(units, "units")
    langs = units.groupBy("lang").agg(F.sum("bytes").alias("of"))
    share = F.greatest(F.lit(1), F.ceil(F.lit(support).cast("decimal(10,0)") * F.col("bytes").cast("decimal(18,0)") / F.col("of").cast("decimal(18,0)"))).cast("long")
    units = materialize(units.join(langs, "lang").select("shard", "lang", share.alias("least")), "local-support")
    slack = units.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("slack"))
    heads = units.join(slack, "lang").select("shard", "lang", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("hashes"), "least", "slack")
    texts = laid.select("shard", "lang", F.lit(1).alias("kind"), "text", F.lit(None).cast("binary").alias("hashes"), F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("slack"))
    found = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("slack", pa.int64())])
    finds = _dealt(heads.unionByName(texts), parts).mapInArrow(_by_unit(_Miner, found, longest, buckets), FINDS)
    union = finds.groupBy("bucket").applyInArrow(_united(support), "shard int, lang string, hashes binary")
    heads = union.select("shard", "lang", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "hashes", F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("slack"))
    counted = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
    counts = _dealt(heads.unionByName(texts), parts).mapInArrow(_by_unit(_Counter, counted, longest, buckets), "lang string, words int, phrase string, n long")
    return counts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= support) | (F.col("words") == 0))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "lang", "kind")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, most: int = 2000, inside_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``most`` best phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r count a phrase and its parts at its lowest-scoring cut (ties to the earliest); the score is floor(10^6 a a / (l r)).
    A phrase whose words lie inside a longer one of at least ``inside_percent`` of its occurrences is left out. Ties in score go to the
    larger a, then to the phrase that comes first in byte order. Null texts are empty, null languages are ``und``; rows that repeat
    count each time; a table without words gives no rows. Only the named columns are read.
    """
    counts = materialize(frequent_phrases(docs, support, longest, id_col, text_col, lang_col), "phrases")
    whole = counts.filter("words >= 2").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a"))
    joined = lambda w: F.array_join(w, " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), joined(F.slice("w", F.lit(1), k)).alias("first"), joined(F.slice("w", k + 1, F.size("w") - k)).alias("rest")))
    cut = whole.select("lang", "phrase", "a", F.inline(cuts))
    part = lambda name, n: counts.filter("words >= 1").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cut = cut.withColumn("score", F.expr("cast(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"))
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda s: joined(F.slice("w", s, m)))))
    inside = whole.filter(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = lowest.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(wide("longer") * 100 < wide("a") * inside_percent, F.lit(True)))
    best = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in (256, 16, 1):  # the best of each group meet in fewer groups, so no task orders a whole language
        group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(group).cast("long")).filter(F.col("rank") <= most)
    total = counts.filter("words = 0").select("lang", F.col("n").alias("total"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
