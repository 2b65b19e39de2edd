"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cell floor((a . v + b) / width) in each of some random
directions a. A query visits its own cell and then neighbouring cells in the order in
which they are likely to hold close vectors; that order follows from how near the query lies to the cell's
walls. The vectors of all visited cells of all tables are ranked by their exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import MIX, ragged, scramble
from marketloom.session import materialize, sized_broadcast

TABLES = 5
DIRECTIONS = 12
WIDTH = 1.77  # of the median distance of two vectors
MOST_PROBES = 20_000
SAMPLE = 500  # vectors whose distances set the width
TUNING = 40  # queries whose true neighbours set the number of probes
SLOT_ROWS = 50_000
QUERY_ROWS = 20_000


@dataclass
class Hashes:
    """Directions (dimension, tables * directions), shifts and width, and the probing order over a query's walls sorted by nearness."""

    along: np.ndarray
    shift: np.ndarray
    width: float
    order: np.ndarray


def probing_order(directions: int, most: int) -> np.ndarray:
    """Sets of walls to cross, by expected score, as rows of 0 and 1 over the 2 * directions walls from nearest to farthest.

    The expected squared distance of the j-th nearest wall is known beforehand, so
    the order is found once and serves all queries. Walls j and 2 * directions + 1 - j belong to one
    direction and are never crossed together.
    """
    m = directions
    j = np.arange(1, 2 * m + 1)
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    rows = [np.zeros(2 * m, np.int8)]
    queue = [(cost[0], (0,))]
    while queue and len(rows) < most:
        value, walls = heapq.heappop(queue)
        if all(2 * m - 1 - w not in walls for w in walls):
            row = np.zeros(2 * m, np.int8)
            row[list(walls)] = 1
            rows.append(row)
        last = walls[-1]
        if last + 1 < 2 * m:
            heapq.heappush(queue, (value - cost[last] + cost[last + 1], (*walls[:-1], last + 1)))
            heapq.heappush(queue, (value + cost[last + 1], (*walls, last + 1)))
    return np.stack(rows)


def cells(hashes: Hashes, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (rows, tables, directions) and places within the cells, 0 to 1."""
    at = (vectors @ hashes.along + hashes.shift) / hashes.width
    cell = np.floor(at)
    shape = (len(vectors), -1, DIRECTIONS)
    return cell.astype(np.int64).reshape(shape), (at - cell).reshape(shape)


def keys_of(cell: np.ndarray, table: int) -> np.ndarray:
    """64-bit key of cells (rows, directions) of a table."""
    h = np.full(cell.shape[:-1], table + 1, np.uint64)
    for k in range(cell.shape[-1]):
        h = scramble((h + cell[..., k].astype(np.uint64)) * MIX)
    return h.astype(np.int64)


def probes(hashes: Hashes, cell: np.ndarray, place: np.ndarray, count: int, table: int) -> np.ndarray:
    """Keys of the first ``count`` cells that a query (one table) visits."""
    wall = np.concatenate([place, 1 - place])
    near = np.argsort(wall, kind="stable")
    step = np.zeros((len(wall), DIRECTIONS), np.int64)
    step[np.arange(len(wall)), near % DIRECTIONS] = np.where(near < DIRECTIONS, -1, 1)
    return keys_of(cell + hashes.order[:count].astype(np.int64) @ step, table)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector of finite components that are not all zero, of the most common dimension."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == sizes[0]["n"]) if sizes else rows


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _nearest(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows other than the query's own id; ties go to the smaller id."""
    other = ids != query_id
    ids, gap = ids[other], vectors[other] - query
    far = np.sqrt((gap * gap).sum(1))
    best = np.lexsort((ids, far))
    best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k] if len(best) else best
    return ids[best], far[best]


def exhaustive(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest of a bounded list of queries, from each task's share of the rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, vectors = batch["id"].to_numpy(), _stack(batch["v"])
            for q, vector in queries:
                near, far = _nearest(ids, vectors, q, np.array(vector), k)
                yield pd.DataFrame({"query_id": q, "vec_id": near, "score": far})

    return _top(rows.mapInPandas(work, "query_id long, vec_id long, score double"), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit(rows: DataFrame, total: int, seed: int, k: int, recall: float) -> tuple[Hashes, int] | None:
    """Hashes and the number of probes per table.

    Bound: ``SAMPLE`` vectors set the width, and the true neighbours of ``TUNING`` of them, found among all
    rows, the number of probes: the least that would have visited ``recall`` of these.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_003))
    sample = rows.filter(place < F.lit(1_000_003.0 * 2 * SAMPLE / total)).orderBy(place, "id").limit(SAMPLE).collect()
    if not sample:
        return None
    v = np.array([r["v"] for r in sample])
    gaps = np.sqrt(np.maximum(((v[:, None] - v[None, : min(len(v), 50)]) ** 2).sum(2), 0))
    typical = float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 1.0
    random = np.random.default_rng(seed)
    width = WIDTH * typical
    hashes = Hashes(random.standard_normal((v.shape[1], TABLES * DIRECTIONS)), random.uniform(0, width, TABLES * DIRECTIONS), width, probing_order(DIRECTIONS, MOST_PROBES))
    asked = [(r["id"], list(r["v"])) for r in sample[:TUNING]]
    true = exhaustive(rows, asked, k).join(rows.withColumnRenamed("id", "vec_id"), "vec_id").select("query_id", "v").collect()
    if not true:
        return hashes, 1
    needed = []
    of = {q: (i, np.array(vector)) for i, (q, vector) in enumerate(asked)}
    for q in {r["query_id"] for r in true}:
        cell, at = cells(hashes, of[q][1][None])
        theirs, _ = cells(hashes, np.array([r["v"] for r in true if r["query_id"] == q]))
        best = np.full(len(theirs), MOST_PROBES)
        for t in range(TABLES):
            visited = probes(hashes, cell[0, t], at[0, t], MOST_PROBES, t)
            order = np.argsort(visited, kind="stable")
            key = keys_of(theirs[:, t], t)
            slot = np.minimum(np.searchsorted(visited[order], key), len(order) - 1)
            best = np.minimum(best, np.where(visited[order][slot] == key, order[slot] + 1, MOST_PROBES))
        needed.extend(best.tolist())
    return hashes, int(np.quantile(needed, recall, method="higher"))


def _index(hashes: Hashes, slots: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, _ = cells(hashes, _stack(batch["v"]))
            for t in range(TABLES):
                key = keys_of(cell[:, t], t)
                yield pd.DataFrame({"slot": key % slots, "key": key, "id": batch["id"], "v": batch["v"]})

    return work


def _ask(hashes: Hashes, count: int, slots: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, place = cells(hashes, _stack(batch["v"]))
            for i, (q, v) in enumerate(zip(batch["id"], batch["v"])):
                keys = np.unique(np.concatenate([probes(hashes, cell[i, t], place[i, t], count, t) for t in range(TABLES)]))
                slot = keys % slots
                order = np.argsort(slot, kind="stable")
                own, begin = np.unique(slot[order], return_index=True)
                yield pd.DataFrame({"slot": own, "query_id": q, "query": [v] * len(own), "keys": np.split(keys[order], begin[1:])})

    return work


def _rank(k: int):
    def work(index: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(asks):
            index = index.sort_values("key", kind="stable")
            key, ids, vectors = index["key"].to_numpy(), index["id"].to_numpy(), _stack(index["v"])
            for q, vector, wanted in zip(asks["query_id"], asks["query"], asks["keys"]):
                wanted = np.asarray(wanted, np.int64)
                low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
                rows = ragged(low, high - low)
                if len(rows):
                    near, far = _nearest(ids[rows], vectors[rows], q, np.asarray(vector, np.float64), k)
                    out.append(pd.DataFrame({"query_id": q, "vec_id": near, "score": far}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return work


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = 0.95, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found for each row for which ``is_query`` (a condition on ``id``) holds.

    Rows without id, and vectors that are null, zero, hold null or non-finite components or
    have another dimension than most take no part. A query's own id is no candidate; rows that
    repeat an id count once, with the nearer vector. A query that finds fewer than k is compared with all rows, so that
    it gets all candidates if there are fewer. An empty table gives no rows. Other columns are not read.

    Rows are dealt by cell to slots of about ``SLOT_ROWS``; a slot that a crowded cell makes larger
    is split by id, and each part is asked. Queries go in blocks.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    total = rows.count()
    fitted = fit(rows, total, seed, k, recall) if total else None
    schema = "query_id long, rank int, vec_id long, score double"
    if fitted is None:
        return spark.createDataFrame([], schema)
    hashes, count = fitted
    slots = max(16, -(-total * TABLES // SLOT_ROWS))
    queries = rows.filter(is_query)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    index = materialize(rows.mapInPandas(_index(hashes, slots), "slot long, key long, id long, v array<double>"), "index")
    parts = sized_broadcast(index.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / (4 * SLOT_ROWS)).cast("int").alias("parts")))
    split = index.join(parts, "slot").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = queries.mapInPandas(_ask(hashes, count, slots), "slot long, query_id long, query array<double>, keys array<long>").join(parts, "slot")
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    by = ["slot", "part", "block"]
    found = split.select(*by, "key", "id", "v").groupBy(*by).cogroup(asks.select(*by, "query_id", "query", "keys").groupBy(*by)).applyInPandas(_rank(k), "query_id long, vec_id long, score double")
    best = materialize(_top(found, k), "nearest")
    enough = best.groupBy("query_id").count().filter(F.col("count") >= k)
    short = materialize(queries.join(enough, queries["id"] == enough["query_id"], "left_anti").select("id", "v"), "short")
    if short.limit(1).count():
        best = best.join(enough, "query_id", "left_semi").unionByName(_all_of(rows, short, k))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _all_of(rows: DataFrame, short: DataFrame, k: int) -> DataFrame:
    """The k nearest of all rows for queries that found too few: each block of queries meets each block of rows."""
    row_blocks, ask_blocks = (max(1, -(-df.count() // QUERY_ROWS)) for df in (rows, short))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.select("id", "v", own(row_blocks).alias("part")).withColumn("block", every(ask_blocks)).withColumn("key", F.lit(0).cast("long"))
    right = short.select(F.col("id").alias("query_id"), F.col("v").alias("query"), own(ask_blocks).alias("block")).withColumn("part", every(row_blocks)).withColumn("keys", F.array(F.lit(0).cast("long")))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(_rank(k), "query_id long, vec_id long, score double")
    return _top(found, k)
