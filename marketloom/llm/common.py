"""Helpers shared by the corpus operators: Arrow columns as arrays, bounded slabs, components, ties."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import materialize

T = TypeVar("T")
MIX = np.uint64(0x9E3779B97F4A7C15)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return content[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with up to ``most`` units each; a longer row stands alone."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of all ranges, one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def sent(spark: SparkSession, model: T) -> Callable[[], T]:
    """Broadcast a dataclass; call the result inside a task to get it.

    Only its plain fields are broadcast and the class travels with the task's code, so workers need no copy of this package.
    """
    kind = type(model)
    plain = spark.sparkContext.broadcast({f.name: getattr(model, f.name) for f in fields(model)})
    return lambda: kind(**plain.value)


def scramble(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): the smallest node of each connected component of edges (a, b).

    Each round takes the smallest label among a node and its neighbours, then the
    label of that label; rounds end when none changes. A hub's rows meet only in
    aggregates that are combined on the map side.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(most):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        least = seen.union(labels.select("node", "label", F.col("label").alias("was"))).groupBy("node").agg(F.min("label").alias("near"), F.max("was").alias("was"))
        up = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = materialize(least.join(up, "near").select("node", F.least("near", "far").alias("label"), "was"), "labels")
        labels = after.select("node", "label")
        if not after.filter("label != was").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
