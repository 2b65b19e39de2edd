"""Unions, differences and keyed merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import top_n


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_tagged(frames: dict[str, DataFrame], tag: str = "type") -> DataFrame:
    return union_by_name(*[df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def union_first_wins(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union where the earliest frame supplies each key."""
    stacked = union_by_name(*[df.withColumn("_priority", F.lit(i)) for i, df in enumerate(frames)])
    return top_n(stacked, keys, [F.asc("_priority")]).drop("_priority")


def key_difference(left: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    out = left.select(key).distinct()
    for other in others:
        out = out.join(other.select(key), key, "left_anti")
    return out


def distinct_values(frames: list[DataFrame], column: str) -> DataFrame:
    return union_by_name(*[df.select(column) for df in frames]).distinct()


def last_page_wins(pages: DataFrame, key: str = "url", value: str = "status", order: list[str] = ("page_no", "pos")) -> DataFrame:
    """url -> status over all result pages, later pages overwriting earlier ones."""
    return pages.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
