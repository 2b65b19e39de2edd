"""Nearest neighbours by cosine distance, exact.

Few queries: they are broadcast (after a count) and every task keeps its own
top k of the vectors it reads; one linear scan.

Many queries: vectors are cut into cells around pivots. For each query an upper
bound on its k-th distance, from the k smallest radii of the cells, rules out
cells by the triangle inequality, and only the remaining (query, cell) pairs
meet. Crowded cells are cut into bounded slices. Where the cells rule out
little, as among random directions, sending each query to nearly every cell
would cost more than the products: blocks of queries and blocks of rows meet
instead. Each task multiplies two bounded matrices and returns k rows per query,
never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .matching import full_width
from .sorting import hashed_order
from .windows import top_n

BROADCAST_QUERIES = 2_000
MAX_PIVOTS = 1_024
ROWS_PER_SLICE = 8_192
ROWS_PER_BLOCK = 65_536
QUERIES_PER_BLOCK = 8_192
PROBES = 256  # queries that show how much the cells rule out
DENSE_SHARE = 0.125  # share of the rows left to a query from which blocks meet
_STEP = 4_096  # columns of a product looked at in one go
_SLACK = 1e-6  # covers rounding of distances and of square roots near zero


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


def _top_pairs(q_ids: np.ndarray, q: np.ndarray, t_ids: np.ndarray, t: np.ndarray, k: int, skip_same: bool) -> pd.DataFrame:
    """k nearest of `t` for each row of `q`; both are unit vectors.

    Rows come by ascending id, so a later one of equal distance loses. Past the first step only
    products above each query's k-th so far are looked at, ties at it not among them.
    """
    order = np.argsort(t_ids, kind="stable")
    t_ids, t = t_ids[order], t[order]
    found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    kth = np.full(len(q_ids), np.inf)
    for start in range(0, len(t_ids), max(_STEP, k)):
        some = slice(start, start + max(_STEP, k))
        likeness = q @ t[some].T
        if start:
            rows, cols = np.nonzero(likeness > (1.0 - kth + 4e-10)[:, None])
        else:
            distance = np.where(np.isfinite(likeness), 1.0 - likeness, np.inf)
            if skip_same:
                distance[q_ids[:, None] == t_ids[None, some]] = np.inf
            edge = np.partition(distance, k - 1, axis=1)[:, k - 1 : k] + 1e-9 if k < distance.shape[1] else np.inf
            rows, cols = np.nonzero((distance <= edge) & np.isfinite(distance))
        near = np.round(1.0 - likeness[rows, cols], 9) + 0.0
        cols = cols + start
        if skip_same:
            other = q_ids[rows] != t_ids[cols]
            rows, cols, near = rows[other], cols[other], near[other]
        if not len(rows):
            continue
        rows, cols, near = (np.concatenate([old, new]) for old, new in zip(found, (rows, cols, near)))
        order = np.lexsort((cols, near, rows))
        rows, cols, near = rows[order], cols[order], near[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kth[rows[place == k - 1]] = near[place == k - 1]
        found = (rows[place < k], cols[place < k], near[place < k])
    rows, cols, near = found
    return pd.DataFrame({"query_id": q_ids[rows], "neighbour_id": t_ids[cols], "distance": near})


_PAIRS = "query_id long, neighbour_id long, distance double"


def _final(pairs: DataFrame, k: int) -> DataFrame:
    return top_n(pairs, ["query_id"], [F.asc("distance"), F.asc("neighbour_id")], k, rank="rank")


def nearest(
    queries: DataFrame, train: DataFrame, k: int = 30, key: str = "vec_id", vector: str = "embedding",
    skip_same: bool = False, broadcast_limit: int = BROADCAST_QUERIES,
) -> DataFrame:
    """k nearest train vectors per query: query_id, neighbour_id, distance, rank."""
    q = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).na.drop()
    t = train.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).na.drop()
    if q.limit(broadcast_limit + 1).count() <= broadcast_limit:
        return nearest_few(q, t, k, skip_same)
    return nearest_many(q, t, k, skip_same)


def nearest_few(q: DataFrame, t: DataFrame, k: int, skip_same: bool) -> DataFrame:
    """Bounded query set: scan the train vectors once."""
    rows = q.toPandas()
    shared = q.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), _unit(_stack(rows["v"]))))

    def scan(batches):
        ids, vectors = shared.value
        if not len(ids):
            return
        best = None
        for batch in batches:
            if batch.empty:
                continue
            found = _top_pairs(ids, vectors, batch["id"].to_numpy(), _unit(_stack(batch["v"])), k, skip_same)
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["query_id", "distance", "neighbour_id"]).groupby("query_id", sort=False).head(k)
        if best is not None:
            yield best

    return _final(t.mapInPandas(scan, _PAIRS), k)


def _top_blocks(a: pd.DataFrame, b: pd.DataFrame, k: int, skip_same: bool) -> pd.DataFrame:
    if a.empty or b.empty:
        return pd.DataFrame({"query_id": [], "neighbour_id": [], "distance": []})
    ids, vectors = b["id"].to_numpy(), _unit(_stack(b["v"]))
    q_ids, q = a["id"].to_numpy(), _unit(_stack(a["v"]))
    return pd.concat([_top_pairs(q_ids[i : i + 512], q[i : i + 512], ids, vectors, k, skip_same) for i in range(0, len(a), 512)])


def nearest_in_blocks(q: DataFrame, t: DataFrame, n: int, k: int, skip_same: bool) -> DataFrame:
    """Every query against all `n` rows: blocks of queries meet blocks of rows, each meeting gives k rows per query."""
    groups = max(1, math.ceil(q.count() / QUERIES_PER_BLOCK))
    spread = math.ceil(2 * t.sparkSession.sparkContext.defaultParallelism / groups)
    slices = max(1, math.ceil(n / ROWS_PER_BLOCK), min(math.ceil(n / _STEP), spread))
    slot = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = q.select("id", "v", slot(groups).alias("g"), every(slices).alias("s"))
    right = t.select("id", "v", slot(slices).alias("s"), every(groups).alias("g"))
    place = (F.col("g") * slices + F.col("s")).alias("block")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _top_blocks(a, b, k, skip_same)

    sides = [side.select(place, "id", "v").repartition(groups * slices, "block").groupBy("block") for side in (left, right)]
    return _final(sides[0].cogroup(sides[1]).applyInPandas(meet, _PAIRS), k)


def nearest_many(
    q: DataFrame, t: DataFrame, k: int, skip_same: bool, pivots: int | None = None, dense_share: float = DENSE_SHARE
) -> DataFrame:
    spark = t.sparkSession
    n = t.count()
    n_pivots = pivots or max(1, min(MAX_PIVOTS, int(math.sqrt(n))))
    # The pivots are a bounded sample (at most MAX_PIVOTS vectors); any choice gives exact results.
    sample = t.orderBy(hashed_order("id"), "id").limit(n_pivots).toPandas()
    centres = spark.sparkContext.broadcast(_unit(_stack(sample["v"])))

    assigned_schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("v", t.schema["v"].dataType),
         T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
    )

    def assign(batches):
        for batch in batches:
            if not batch.empty:
                gaps = _gaps(_unit(_stack(batch["v"])), centres.value)
                cell = gaps.argmin(axis=1)
                yield batch.assign(cell=cell.astype("int32"), radius=gaps[np.arange(len(cell)), cell])

    # Written once: the cell summaries and the meeting both read the assignment.
    placed = materialize(t.mapInPandas(assign, assigned_schema), "cells")
    # One summary row per cell: size, radius range and the k+1 smallest radii.
    near = top_n(placed.select("cell", "radius", "id"), ["cell"], [F.asc("radius"), F.asc("id")], k + 1)
    near = near.groupBy("cell").agg(F.array_sort(F.collect_list("radius")).alias("radii"))
    spans = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")
    )
    cells = spans.join(near, "cell").toPandas().sort_values("cell")
    summary = spark.sparkContext.broadcast(
        (cells["cell"].to_numpy(), cells["low"].to_numpy(), cells["high"].to_numpy(), cells["radii"].tolist())
    )
    slices = {int(c): math.ceil(m / ROWS_PER_SLICE) for c, m in zip(cells["cell"], cells["n"])}
    slice_rows = spark.createDataFrame(list(slices.items()), "cell int, n_slices int") if slices else None
    if slice_rows is None:
        return spark.createDataFrame([], f"{_PAIRS}, rank int")

    need = k + 1 if skip_same else k

    def picks(vectors: np.ndarray, pivots: np.ndarray, cells: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) by position, of the cells that may hold one of a query's k nearest."""
        numbers, low, high, radii = cells
        pooled = np.concatenate([np.asarray(r) for r in radii])
        owner = np.repeat(np.arange(len(numbers)), [len(r) for r in radii])
        gaps = _gaps(_unit(vectors), pivots)[:, numbers]
        if len(pooled) >= need:
            reach = np.partition(gaps[:, owner] + pooled, need - 1, axis=1)[:, need - 1]
            bound = np.sqrt(reach**2 + 4e-9) + _SLACK
        else:
            bound = np.full(len(vectors), np.inf)
        lower = np.maximum(np.maximum(gaps - high, low - gaps), 0.0)
        return np.nonzero(lower <= bound[:, None])

    # Which way to go is read off a few queries; the result is the same.
    probes = q.orderBy(hashed_order("id"), "id").limit(PROBES).toPandas()
    if len(probes):
        met = picks(_stack(probes["v"]), centres.value, summary.value)[1]
        if cells["n"].to_numpy()[met].sum() >= dense_share * n * len(probes):
            return nearest_in_blocks(q, t, n, k, skip_same)

    visit_schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("v", q.schema["v"].dataType), T.StructField("cell", T.IntegerType())]
    )

    def visit(batches):
        """Send each query to the cells that may hold one of its k nearest."""
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512]
                rows, found = picks(_stack(part["v"]), centres.value, summary.value)
                yield part.iloc[rows].assign(cell=summary.value[0][found].astype("int32"))

    visits = materialize(q.mapInPandas(visit, visit_schema), "visits")
    # Query slices: as many per cell as its visitors need.
    slot = lambda c, m: F.pmod(F.xxhash64(c), F.col(m).cast("bigint")).cast("int")
    visitors = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SLICE).cast("int").alias("n_groups"))
    sized = F.broadcast(slice_rows)  # at most MAX_PIVOTS rows
    grouped = F.broadcast(visitors)  # at most MAX_PIVOTS rows
    left = (
        visits.join(grouped, "cell").withColumn("g", slot("id", "n_groups")).join(sized, "cell")
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)))
        .select("cell", "g", "s", "id", "v")
    )
    right = (
        placed.select("cell", "id", "v").join(sized, "cell").withColumn("s", slot("id", "n_slices")).join(grouped, "cell")
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)))
        .select("cell", "g", "s", "id", "v")
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _top_blocks(a, b, k, skip_same)

    keys = ["cell", "g", "s"]
    met = full_width(left, keys).groupBy(*keys).cogroup(full_width(right, keys).groupBy(*keys))
    return _final(met.applyInPandas(meet, _PAIRS), k)


def _gaps(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (vectors @ centres.T), 0.0))
