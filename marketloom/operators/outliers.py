"""Isolation forest: trees grown level by level on hashed samples, kept as a table, scores as a column.

The forest is a table with one row per tree. Trees are packed into groups of at
most `GROUP_BYTES`. A forest of one group travels to the rows, which are scored
where they lie. A larger one never meets in one place: blocks of rows and groups
of trees meet slot by slot, each meeting gives partial sums of path lengths, and
the sums of a block are added up. Neither the number of trees nor the size of
the samples is limited.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .matching import full_width
from .windows import top_n

GROUP_BYTES = 32_000_000
BLOCKS_PER_SLOT = 64
ROWS_IN_CACHE = 4_096
_NODE_BYTES = 14  # feature int16, lower int32, cut float64
_LARGEST = 1e300  # differences of two values stay finite
_TREE = "tree int, feature binary, lower binary, cut binary"


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    many = np.maximum(n, 3.0)
    long = 2.0 * (np.log(many - 1.0) + 0.5772156649015329) - 2.0 * (many - 1.0) / many
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def tree_samples(df: DataFrame, key: str, trees: int, samples: int, seed: int = 42) -> DataFrame:
    """(tree, row) samples: each row is dealt to as many trees as needed to fill them.

    Of many rows a hashed share is drawn first, so that what travels follows the
    model and not the data. Surplus rows of a tree are cut by a bounded rank, so
    no tree gathers more than `samples`.
    """
    n = max(df.count(), 1)
    wanted = trees * samples * 1.3
    copies = min(trees, max(1, math.ceil(wanted / n)))
    share = min(1.0, wanted / (n * copies))
    dealt = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    uniform = lambda salt: F.pmod(F.xxhash64(F.col(key), F.col("_copy"), F.lit(salt)), F.lit(2**31)) / 2**31
    if share < 1.0:
        dealt = dealt.where(uniform(seed + 2) < share)
    tree = F.least(F.floor((F.col("_copy") + uniform(seed)) * (trees / copies)), F.lit(trees - 1)).cast("int")
    return top_n(dealt.withColumn("tree", tree), ["tree"], [F.xxhash64(F.col(key), F.lit(seed + 1)), F.col(key)], samples)


def _grow_tree(data: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in level order: feature (-1: leaf), number of the lower child (the upper one follows it),
    cut (leaf: path length). All nodes of a level are cut together."""
    features, lowers, cuts = [], [], []
    place, width, first = np.zeros(len(data), dtype=np.int64), 1, 0
    for depth in range(limit + 1):
        order = np.argsort(place, kind="stable")
        data, place = data[order], place[order]
        starts = np.searchsorted(place, np.arange(width))
        low, high = np.minimum.reduceat(data, starts), np.maximum.reduceat(data, starts)
        spread = high > low
        inner = spread.any(axis=1) & (depth < limit)
        pick = np.where(spread, rng.random(spread.shape), -1.0).argmax(axis=1)
        nodes = np.arange(width)
        low, high = low[nodes, pick], high[nodes, pick]
        # Below the largest value, so that both children hold rows.
        cut = np.minimum(low + rng.random(width) * (high - low), np.nextafter(high, low))
        child = 2 * (np.cumsum(inner) - 1)
        features.append(np.where(inner, pick, -1))
        lowers.append(np.where(inner, first + width + child, -1))
        sizes = np.diff(np.append(starts, len(data)))
        cuts.append(np.where(inner, cut, depth + _path_length(sizes)))
        kept = inner[place]
        data, place = data[kept], place[kept]
        if not len(data):
            break
        above = data[np.arange(len(data)), pick[place]] > cut[place]
        place = child[place] + above
        first, width = first + width, 2 * int(inner.sum())
    return np.concatenate(features).astype("<i2"), np.concatenate(lowers).astype("<i4"), np.concatenate(cuts).astype("<f8")


def grow(sampled: DataFrame, columns: list[str], samples: int, seed: int = 42) -> DataFrame:
    """The forest, one row per tree with its nodes as packed arrays."""
    limit = max(1, math.ceil(math.log2(max(samples, 2))))

    def one_tree(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["tree"].iloc[0])
        data = rows[columns].to_numpy(dtype=np.float64)
        data = data[np.lexsort(data.T)]  # arrival order does not matter
        nodes = _grow_tree(data, limit, np.random.default_rng([seed, number]))
        return pd.DataFrame([(number, *[part.tobytes() for part in nodes])], columns=["tree", "feature", "lower", "cut"])

    return sampled.select("tree", *columns).groupBy("tree").applyInPandas(one_tree, _TREE)


def tree_groups(forest: DataFrame, samples: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(group, trees): neighbouring trees whose nodes together take at most `group_bytes` (one tree, if it is larger)."""
    each = max(1, group_bytes // (2 * samples * _NODE_BYTES))
    tree = F.struct("tree", "feature", "lower", "cut")
    return forest.groupBy(F.floor(F.col("tree") / each).cast("int").alias("group")).agg(
        F.array_sort(F.collect_list(tree)).alias("trees")
    )


def _unpack(trees) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [
        (np.frombuffer(t["feature"], "<i2"), np.frombuffer(t["lower"], "<i4"), np.frombuffer(t["cut"], "<f8")) for t in trees
    ]


def _level_tables(tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nodes such that every row takes the same number of steps: a leaf leads to itself."""
    feature, lower, cut = tree
    leaf = feature < 0
    depth, level = 0, np.zeros(1, dtype=np.int64)
    while len(level := level[~leaf[level]]):
        level = np.concatenate([lower[level], lower[level] + 1]).astype(np.int64)
        depth += 1
    onward = np.where(leaf, np.arange(len(leaf)), lower).astype(np.intp)
    return np.where(leaf, 0, feature).astype(np.intp), onward, np.where(leaf, np.inf, cut), cut, depth


def _path_sums(data: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum over the trees of each row's path length, for as many rows at a time as stay in cache."""
    total, width, flat = np.zeros(len(data)), data.shape[1], np.ascontiguousarray(data, dtype=np.float64).ravel()
    tables = [_level_tables(tree) for tree in trees]
    for start in range(0, len(data), ROWS_IN_CACHE):
        some = slice(start, start + ROWS_IN_CACHE)
        first = np.arange(len(data), dtype=np.intp)[some] * width
        for feature, onward, cut, length, depth in tables:
            at = np.zeros(len(first), dtype=np.intp)
            for _ in range(depth):
                place = feature.take(at, mode="clip")
                place += first
                above = flat.take(place, mode="clip") > cut.take(at, mode="clip")
                at = onward.take(at, mode="clip")
                at += above
            total[some] += length.take(at, mode="clip")
    return total


def _sums_in_place(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Rows with `_paths`; the forest is one group, at most `GROUP_BYTES` or one tree."""
    shared = rows.sparkSession.sparkContext.broadcast([t.asDict() for t in groups.first()["trees"]])

    @F.pandas_udf(T.DoubleType())
    def paths(values: pd.Series) -> pd.Series:
        return pd.Series(_path_sums(np.stack(values), _unpack(shared.value)))

    return rows.withColumn("_paths", paths("_values"))


def _sums_by_group(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Rows with `_paths`, from partial sums of (block of rows, group of trees)."""
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "outlier-rows")

    def pack(batches):
        for batch in batches:
            if len(batch):
                values = np.stack(batch["_values"]).astype("<f8").tobytes()
                yield pd.DataFrame({"block": [uuid.uuid4().hex], "ids": [batch["_row"].to_numpy()], "data": [values]})

    packed = numbered.select("_row", "_values").mapInPandas(pack, "block string, ids array<long>, data binary")
    blocks = materialize(packed, "outlier-blocks")  # block names are drawn once
    slots = max(1, math.ceil(blocks.count() / BLOCKS_PER_SLOT))
    left = (
        blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        .select("group", "slot", "block", F.size("ids").alias("n"), "data")
    )
    right = groups.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def meet(some: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if some.empty or group.empty:
            return pd.DataFrame({"block": [], "group": [], "part": []}, dtype=object)  # Arrow makes no lists of floats
        trees = _unpack(group["trees"].iloc[0])
        sums = [_path_sums(np.frombuffer(d, "<f8").reshape(n, -1), trees) for d, n in zip(some["data"], some["n"])]
        return pd.DataFrame({"block": some["block"], "group": some["group"], "part": sums})

    keys = ["group", "slot"]
    met = full_width(left, keys).groupBy(*keys).cogroup(full_width(right, keys).groupBy(*keys))
    parts = met.applyInPandas(meet, "block string, group int, part array<double>")
    # As many parts a block as there are groups, added in their order: reruns agree to the last bit.
    added = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("group", "part"))).alias("parts"))
    added = added.select(
        "block",
        F.aggregate(
            F.expr("slice(parts, 2, size(parts))"), F.col("parts")[0]["part"],
            lambda total, p: F.zip_with(total, p["part"], lambda a, b: a + b),
        ).alias("sums"),
    )
    each = blocks.select("block", "ids").join(added, "block").select(F.explode(F.arrays_zip("ids", "sums")).alias("r"))
    return numbered.join(each.select(F.col("r.ids").alias("_row"), F.col("r.sums").alias("_paths")), "_row").drop("_row")


def outlier_scores(
    df: DataFrame, key: str, columns: list[str], trees: int = 1000, samples: int = 10_000, contamination: float = 0.01,
    seed: int = 42, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Rows with `outlier_score` (lower is odder) and `outlier_flag` (-1 for the oddest share).

    Nulls and NaN count as 0, infinities as very large. A table without rows gives none.
    Rows of equal values share a score, so the flagged share may pass `contamination` by ties.
    """
    filled = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns]
    clean = [F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST)) for c in filled]
    names = [f"_c{i}" for i in range(len(columns))]
    rows = df.select(F.col(key).alias("_key"), *[c.alias(n) for c, n in zip(clean, names)])
    # Grown once: the number of groups and every slot read the forest.
    forest = materialize(grow(tree_samples(rows, "_key", trees, samples, seed), names, samples, seed), "forest")
    groups = materialize(tree_groups(forest, samples, group_bytes), "forest-groups")
    grown, n_groups, highest = forest.count(), *groups.agg(F.count(F.lit(1)), F.max("group")).first()
    if not grown:
        return df.withColumns({"outlier_score": F.lit(None).cast("double"), "outlier_flag": F.lit(None).cast("int")})
    sums = _sums_in_place if highest == 0 else _sums_by_group
    scale = float(_path_length(samples)) or 1.0
    score = -F.pow(F.lit(2.0), -F.col("_paths") / F.lit(grown * scale))
    scored = sums(df.withColumn("_values", F.array(*clean)), groups, (highest or 0) + 1)
    # Written once: the threshold and the result both read the scores.
    scored = materialize(scored.withColumn("outlier_score", score).drop("_values", "_paths"), "outlier-scores")
    cut_off = scored.agg(F.percentile_approx("outlier_score", contamination, 100_000)).first()[0]
    return scored.withColumn("outlier_flag", F.when(F.col("outlier_score") <= cut_off, -1).otherwise(1))
