"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

A text's fingerprint is its UTF-8 bytes read as the digits of a number, modulo two
primes. Fingerprints compose: ``fp(a + b) = fp(a) * base ** len(b) + fp(b)``, so
the chunks of a document are hashed side by side and then joined by shifts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import ragged, slabs, utf8
from marketloom.session import materialize, sized_broadcast

# The two largest primes below 2 ** 31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003741, 1618033989)
CHUNK = 1024  # digits of a chunk: 255 * 2 ** 31 * 1024 < 2 ** 53 keeps its float64 dot product exact
COMPARE_BYTES = 65536
SLAB_BYTES = 1_000_000  # a slab's working arrays take some forty bytes for each of its own


def combine(left: int, right: int, right_bytes: int) -> int:
    """Fingerprint of two strings' concatenation from theirs and the second one's length."""
    a, b = _halves(left), _halves(right)
    joined = [(x * pow(base, right_bytes, prime) + y) % prime for x, y, base, prime in zip(a, b, BASES, PRIMES)]
    return joined[0] << 31 | joined[1]


def _halves(fingerprint: int) -> tuple[int, int]:
    return fingerprint >> 31, fingerprint & 0x7FFFFFFF


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = pow(base, len(out), prime)
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
    return out[:n]


def fingerprints(texts: pa.Array) -> pa.Array:
    """Fingerprint of each text; null counts as empty and has fingerprint 0."""
    data, offsets = utf8(texts)
    lengths = np.diff(offsets)
    digits = np.stack([_powers(b, p, CHUNK)[::-1] for b, p in zip(BASES, PRIMES)], 1).astype(np.float64)
    out = np.zeros(len(lengths), np.uint64)
    for start, stop in slabs(lengths, SLAB_BYTES):
        own = lengths[start:stop]
        chunks = -(-own // CHUNK)
        ends = np.cumsum(chunks)
        padded = np.zeros(int(ends[-1]) * CHUNK, np.uint8)  # zeros in front of a text leave its number unchanged
        padded[ragged(ends * CHUNK - own, own)] = data[offsets[start] : offsets[stop]]
        hashes = np.concatenate([part @ digits for part in np.array_split(padded.reshape(-1, CHUNK).astype(np.float32), max(1, len(padded) // SLAB_BYTES))]) if len(padded) else np.zeros((0, 2))
        full, shift = np.flatnonzero(chunks), np.repeat(ends, chunks) - 1 - np.arange(ends[-1])
        halves = []
        for i, (base, prime) in enumerate(zip(BASES, PRIMES)):
            moved = hashes[:, i].astype(np.uint64) % np.uint64(prime) * _powers(pow(base, CHUNK, prime), prime, int(chunks.max(initial=1)))[shift] % np.uint64(prime)
            half = np.zeros(stop - start, np.uint64)
            if len(full):
                half[full] = np.add.reduceat(moved, (ends - chunks)[full]) % np.uint64(prime)
            halves.append(half)
        out[start:stop] = halves[0] << np.uint64(31) | halves[1]
    return pa.array(out.astype(np.int64))


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``_fp`` and ``_bytes``, the key under which texts are compared."""

    def fp(texts: pa.Array) -> pa.Array:
        return fingerprints(texts)

    # Never null, and Spark knows it by the coalesce: else a join on the key first filters by it, in another pass through Python.
    of = F.coalesce(F.arrow_udf(fp, "long")(F.col(text_col)), F.lit(0).cast("long"))
    return docs.withColumn("_fp", of).withColumn("_bytes", F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))


def differing(marked: DataFrame, keys: DataFrame, text_col: str = "text") -> DataFrame:
    """Of the keys (_fp, _bytes), those whose texts are not all the same.

    Texts are cut into chunks; under one key and chunk number the smallest and the
    largest chunk must agree. Both are aggregates with a map side, so a key with a
    third of all rows sends one row per task.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    last = F.expr(f"cast(greatest(_bytes - 1, 0) div {COMPARE_BYTES} as int)")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("no"), F.substring(raw, i * COMPARE_BYTES + 1, F.lit(COMPARE_BYTES)).alias("part")))
    members = marked.join(sized_broadcast(keys), ["_fp", "_bytes"])
    chunks = members.select("_fp", "_bytes", F.explode(cut).alias("c")).select("_fp", "_bytes", F.col("c.no").alias("no"), F.col("c.part").alias("part"))
    spread = chunks.groupBy("_fp", "_bytes", "no").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return spread.filter("low != high").select("_fp", "_bytes").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its group of equal texts and whether it stays.

    Columns: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and the key ``_fp``, ``_bytes``, ``_split``.
    Null texts equal empty ones. The largest id stays; of rows that share it one
    stays, and null ids come last. An empty table gives no rows. Only the named
    columns are read, so others may have any name.
    """
    marked = with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    small = materialize(marked.select("_id", "_fp", "_bytes", F.sha2(F.coalesce("_text", F.lit("")), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")), "fingerprints")
    repeated = materialize(small.groupBy("_fp", "_bytes").count().filter("count > 1").select("_fp", "_bytes"), "repeated")
    unequal = materialize(differing(marked, repeated, "_text"), "unequal")
    told = small.join(sized_broadcast(unequal.withColumn("_unequal", F.lit(True))), ["_fp", "_bytes"], "left")
    told = told.withColumn("_split", F.when(F.col("_unequal"), F.col("text_sha256")).otherwise("")).drop("_unequal")
    key = ["_fp", "_bytes", "_split"]
    groups = told.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct(F.col("_id"), F.col("_row"))).alias("_keep"))
    joined = told.join(groups, key)
    return joined.select(
        F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), "text_sha256", *key
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; see ``exact_groups`` for which they are.

    Equal rows that share id and text differ in other columns at most; one of them stays.
    """
    groups = materialize(exact_groups(docs, id_col, text_col), "exact-groups")
    same = groups.filter(F.col(id_col).eqNullSafe(F.col("keep_id"))).groupBy(F.col(id_col).alias("_keep_id"), "text_sha256").agg(F.count(F.lit(1)).alias("_ties"))
    same = materialize(same, "kept")
    # Rows of one id and digest are in one group, so they are found without another fingerprint, and a text travels once.
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_sha"))
    stay = named.join(same, (F.col("_sha") == F.col("text_sha256")) & F.col("_id").eqNullSafe(F.col("_keep_id")))
    lone = stay.filter("_ties = 1").select("_row.*")
    if not same.filter("_ties > 1").limit(1).count():
        return lone
    tied = stay.filter("_ties > 1").groupBy("_keep_id", "text_sha256").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return lone.unionByName(tied.select("_row.*"))
