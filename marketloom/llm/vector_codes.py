"""Product codes of vectors by k-means over Hilbert-sorted flat blocks, all in whole numbers.

Each part of a vector is laid along a Hilbert curve and the curve is cut into blocks of neighbours. A block stores its points, the
box around them, their number and their sum. In a round, the distance from an entry to a block's box bounds
its distance to every point in it: an entry whose nearest corner is farther than another entry's farthest one is
nearest to no point of the block. The entries that remain are the block's shortlist. If that is one entry, the block's number and sum
count for it at once; otherwise a small kernel compares the points with the shortlist only.

Codebooks have a fixed size and travel with the tasks; points stay in their blocks, which are written once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

PARTS = 4
ENTRIES = 256
SCALE = 1024
BLOCK_ROWS = 256
BOXES = 64
CURVE_BITS = 64  # bits of a place on the curve
EXACT = 1 << 53

BLOCKS = "part int, rows binary, points binary, low binary, high binary, total binary"


def largest_component(dimension: int) -> int:
    """Whole components below this have squared distances, and sums of them, that fit 62 bits."""
    return int((2.0**60 / max(1, dimension)) ** 0.5)


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, v): floor(1024 x) of each component; vectors that are null or hold null, NaN or infinite components are dropped.

    So are vectors whose whole components reach ``largest_component``, and vectors of another length than the one with the smallest id.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    limit = F.sqrt(F.lit(2.0**60) / F.greatest(F.size(x), F.lit(1)))
    small = F.forall(x, lambda c: F.abs(c.cast("double")) * SCALE < limit - 1)
    kept = table.filter(x.isNotNull() & finite).filter(small)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    named = kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    first = named.select("id", F.size("v").alias("n")).orderBy(F.asc_nulls_last("id"), "n").first()
    if first is None:
        return materialize(named.select(F.lit(0).cast("long").alias("row"), "*").limit(0), "vectors")
    if first["n"] % PARTS or not first["n"]:
        raise ValueError(f"vectors of {first['n']} components do not have {PARTS} equal parts")
    return materialize(named.filter(F.size("v") == first["n"]).select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def curve_places(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of points (rows, dimension) along a Hilbert curve through the box from ``low`` to ``high``, as 64-bit numbers.

    By Skilling's transposition: axes are undone bit by bit from the highest, then the bits
    are read across the axes. Points outside the box count as on its side.
    """
    n = points.shape[1]
    bits = max(1, min(16, CURVE_BITS // n))
    span = np.maximum(high - low, 1)
    x = np.clip(((points - low) * float(1 << bits) / span), 0, (1 << bits) - 1).astype(np.int64)[:, : CURVE_BITS // bits]
    n = x.shape[1]
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << bits - 1
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    place = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << np.uint64(1) | (x[:, i] >> b & 1).astype(np.uint64)
    return place


def blocks_of(vectors: DataFrame, dimension: int) -> DataFrame:
    """Blocks of up to BLOCK_ROWS neighbours on each part's curve (schema BLOCKS); the curve is dealt by range, equal places by row."""
    size = dimension // PARTS
    spread = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("dev")).orderBy("i").collect()
    low = np.array([r["mean"] - 2.5 * r["dev"] for r in spread])
    high = np.array([r["mean"] + 2.5 * r["dev"] for r in spread])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            for part in range(PARTS):
                own = slice(part * size, (part + 1) * size)
                at = curve_places(points[:, own], low[own], high[own]).view(np.int64) ^ np.int64(-1 << 63)
                flat = pa.array(points[:, own].reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * size), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), part, np.int32)), pa.array(at), batch.column("row"), lists], ["part", "place", "row", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            points = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True])
            out = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for i in range(lo, hi, BLOCK_ROWS):
                    p = points[i : min(i + BLOCK_ROWS, hi)]
                    out.append((int(parts[lo]), rows[i : i + len(p)].tobytes(), *(np.ascontiguousarray(x).tobytes() for x in (p, p.min(0), p.max(0), p.sum(0)))))
            for i in range(0, len(out), 64):
                columns = list(zip(*out[i : i + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["part", "rows", "points", "low", "high", "total"])

    laid = vectors.select("row", "v").mapInArrow(placed, "part int, place long, row long, v array<long>")
    dealt = laid.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    return materialize(dealt.mapInArrow(cut, BLOCKS), "blocks")


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries may be nearest to a point of which box: (boxes, entries).

    An entry stays if its least distance to the box does not exceed the least of all entries' greatest distances; an entry that
    ties there may still win by its lower index.
    """
    below, above = low[:, None, :] - book[None], book[None] - high[:, None, :]
    gap = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(book[None] - low[:, None, :]), np.abs(high[:, None, :] - book[None]))
    return (gap * gap).sum(2) <= (far * far).sum(2).min(1)[:, None]


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry (the lowest of equals) and the squared distance, both exact.

    Products go through floating-point multiplication where all sums stay below 2^53, and through whole numbers elsewhere.
    """
    most = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * points.shape[1] < EXACT:
        p, b = points.astype(np.float64), book.astype(np.float64)
        d = (b * b).sum(1)[None] - 2.0 * (p @ b.T)
        best = d.argmin(1)
        return best, (d[np.arange(len(p)), best] + (p * p).sum(1)).astype(np.int64)
    best = np.zeros(len(points), np.int64)
    least = np.full(len(points), np.iinfo(np.int64).max)
    for e, entry in enumerate(book):
        step = points - entry
        d = (step * step).sum(1)
        closer = d < least
        best[closer], least[closer] = e, d[closer]
    return best, least


def _boxes(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, list]]:
    """Blocks of a batch by part, up to BOXES at a time: (part, numbers, columns as matrices)."""
    parts = batch.column("part").to_numpy(zero_copy_only=False)
    wide = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64).reshape(-1, size) for c in ("low", "high", "total")}
    for part in np.unique(parts).tolist():
        of = np.flatnonzero(parts == part)
        for i in range(0, len(of), BOXES):
            own = of[i : i + BOXES]
            yield part, own, [wide[c][own] for c in ("low", "high", "total")]


def _round(books: list[np.ndarray], size: int):
    """Task function: number and sum of the points that each entry is nearest to (part, entry, n, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            points = batch.column("points").to_pylist()
            for part, own, (low, high, sums) in _boxes(batch, size):
                lists = shortlists(low, high, books[part])
                for i, listed, whole in zip(own.tolist(), lists, sums):
                    short = np.flatnonzero(listed)
                    p = np.frombuffer(points[i], np.int64).reshape(-1, size)
                    if len(short) == 1:
                        number[part][short[0]] += len(p)
                        total[part][short[0]] += whole
                    else:
                        best, _ = nearest(p, books[part][short])
                        number[part] += np.bincount(short[best], minlength=len(books[part]))
                        np.add.at(total[part], short[best], p)
        rows = [(p, e, int(n), total[p][e].tolist()) for p in range(PARTS) for e, n in enumerate(number[p].tolist()) if n]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def _codes(books: list[np.ndarray], size: int):
    """Task function: nearest entry and squared distance of each point (row, part, entry, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, rows = batch.column("points").to_pylist(), batch.column("rows").to_pylist()
            for part, own, (low, high, _) in _boxes(batch, size):
                for i, listed in zip(own.tolist(), shortlists(low, high, books[part])):
                    short = np.flatnonzero(listed)
                    best, error = nearest(np.frombuffer(points[i], np.int64).reshape(-1, size), books[part][short])
                    row = np.frombuffer(rows[i], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), part, np.int32)), pa.array(short[best].astype(np.int32)), pa.array(error)], ["row", "part", "entry", "error"])

    return run


def train(vectors: DataFrame, blocks: DataFrame, dimension: int, rounds: int = 4) -> list[np.ndarray]:
    """Codebooks of the parts: they start as the parts of the smallest ids' vectors; a round assigns all points and takes floored means.

    Entries that no point is nearest to stay as they are. Vectors of one id follow each other by their components.
    """
    size = dimension // PARTS
    first = np.array([r["v"] for r in vectors.orderBy(F.asc_nulls_last("id"), "v").limit(ENTRIES).select("v").collect()], np.int64)
    books = [first[:, p * size : (p + 1) * size].copy() for p in range(PARTS)]
    for _ in range(rounds):
        sums = blocks.select("part", "points", "low", "high", "total").mapInArrow(_round(books, size), "part int, entry int, n long, total array<long>")
        total = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(size)]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # one row per entry at most
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return books


def encode(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = 4) -> DataFrame:
    """One row per kept vector: id, code (two hexadecimal digits per part), error, label_error, codebooks_sha256.

    error sums the squared distances to the nearest entries over the parts, label_error sums the errors over the rows of one label,
    null labels together. See ``whole_vectors`` for the rows that are dropped; rows that repeat are kept, each
    with its code. An empty table gives no rows. Only the named columns are read.
    """
    vectors = whole_vectors(table, id_col, vector_col, label_col)
    any_row = vectors.select(F.size("v").alias("n")).first()
    dimension = any_row["n"] if any_row else PARTS
    size = dimension // PARTS
    blocks = blocks_of(vectors, dimension)
    books = train(vectors, blocks, dimension, rounds) if any_row else [np.zeros((0, 1), np.int64)] * PARTS
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    found = blocks.select("part", "rows", "points", "low", "high", "total").mapInArrow(_codes(books, size), "row long, part int, entry int, error long")
    place = F.shiftleft(F.col("entry").cast("long"), 8 * (PARTS - 1))
    for part in range(1, PARTS):
        place = F.when(F.col("part") == part, F.shiftleft(F.col("entry").cast("long"), 8 * (PARTS - 1 - part))).otherwise(place)
    codes = found.groupBy("row").agg(F.sum(place).alias("code"), F.sum("error").alias("error"))
    told = materialize(vectors.select("row", "id", "label").join(codes, "row"), "codes")
    labels = told.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    met = told.join(labels, F.col("label").eqNullSafe(F.col("of")))
    code: Column = F.lpad(F.lower(F.hex("code")), 2 * PARTS, "0")
    return met.select(F.col("id").alias(id_col), F.col("label").alias(label_col), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
