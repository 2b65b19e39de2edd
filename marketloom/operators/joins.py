"""Joins and lookups.

Nothing is broadcast unless its size is fixed in code or has been counted.
Everything else is a plain equi join, which adaptive execution may turn into a
broadcast from measured sizes and whose skewed partitions it splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized_broadcast
from .windows import TIME_UNITS, forward_fill, time_levels, time_unit

FIXED_LOOKUP_ROWS = 200


def fixed_lookup(df: DataFrame, table: dict[str, str], column: str | Column, value: str) -> DataFrame:
    """Attach the value of a fixed table; a miss gives null."""
    if len(table) > FIXED_LOOKUP_ROWS:
        raise ValueError("fixed lookups are small; read larger ones as a table")
    source = F.col(column) if isinstance(column, str) else column
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return df.withColumn(value, F.try_element_at(entries, source))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows unchanged; the job fails at run time when a key occurs twice."""
    counts = df.groupBy(*keys).count()
    twice = F.raise_error(F.concat_ws(" ", F.lit("duplicate key"), *[F.col(k).cast("string") for k in keys]))
    checked = counts.where(F.when(F.col("count") > 1, twice).otherwise(F.lit(True))).drop("count")
    return df.join(checked, keys, "left_semi")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails when either side repeats a key."""
    return assert_unique(left, keys).join(assert_unique(right, keys), keys, "inner")


def attach_series(df: DataFrame, series: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a calendar-sized series (index by year, rate by month)."""
    return df.join(sized_broadcast(series), on, "left")


def right_to_wanted(series: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The series rows of exactly the distinct wanted keys, null where it has none."""
    return series.join(wanted.select(*on).distinct(), on, "right")


def attach_coordinates(df: DataFrame, places: DataFrame, on: str = "location") -> DataFrame:
    """Left join to places, one row per place name (the smallest coordinates win)."""
    one = places.groupBy(on).agg(F.min(F.struct("lon", "lat")).alias("_p"))
    one = one.select(on, "_p.lon", "_p.lat")
    return df.join(sized_broadcast(one), on, "left")


def missing_coordinates(df: DataFrame, places: DataFrame, on: str = "location") -> DataFrame:
    """Distinct place names that still need coordinates."""
    return df.select(on).distinct().join(places, on, "left_anti")


def backfill_coordinates(df: DataFrame, found: DataFrame, on: str = "location") -> DataFrame:
    extra = found.select(on, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    out = df.join(sized_broadcast(extra), on, "left")
    return out.withColumns({"lon": F.coalesce("lon", "_lon"), "lat": F.coalesce("lat", "_lat")}).drop("_lon", "_lat")


def new_rows(current: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    return current.join(stored.select(key), key, "left_anti")


def known_rows(current: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    return current.join(stored.select(key), key, "left_semi")


def vanished_rows(stored: DataFrame, listed: DataFrame, key: str = "url") -> DataFrame:
    return stored.where(F.col(key).isNotNull()).join(listed.select(key), key, "left_anti")


def missed_keys(listed: DataFrame, stored: DataFrame, parsed: DataFrame, key: str = "url") -> DataFrame:
    """Listed but neither stored nor parsed."""
    known = stored.select(key).unionByName(parsed.select(key))
    return listed.select(key).distinct().join(known, key, "left_anti")


def attach_price_drops(df: DataFrame, drops: DataFrame, key: str = "url", fan_out: bool = True) -> DataFrame:
    """Left join price drops: one row per drop, or the largest drop per listing."""
    if not fan_out:
        drops = drops.groupBy(key).agg(F.max("price_change").alias("price_change"))
    return df.join(drops, key, "left")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    bucket: str | None = None,
) -> DataFrame:
    """Last right values at or before each left row; of right rows at one instant the one whose values come last as text.

    Both sides are stacked on one time axis and the values carried forward. The
    carry works per (key, time bucket) and only bucket summaries cross buckets,
    level by level, so a key that holds most of the rows is spread over its
    buckets. Without a given `bucket` (a unit of `TIME_UNITS`) the time unit is
    chosen from the sizes of both sides.
    """
    names = left.columns
    bucket = bucket or min((time_unit(left, by, left_ts), time_unit(right, by, right_ts)), key=lambda u: -TIME_UNITS.index(u))
    stacked = left.select(
        *names,
        F.col(left_ts).alias("_ts"),
        F.lit(1).alias("_side"),
        F.lit("").alias("_tie"),
        *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values],
    )
    rates = right.select(
        *[(F.col(n) if n in by else F.lit(None).cast(left.schema[n].dataType)).alias(n) for n in names],
        F.col(right_ts).cast(left.schema[left_ts].dataType).alias("_ts"),
        F.lit(0).alias("_side"),
        F.to_json(F.struct(*values)).alias("_tie"),
        *[F.col(v).alias(f"_{v}") for v in values],
    )
    carried = forward_fill(
        stacked.unionByName(rates), by, ["_ts", "_side", "_tie"], [f"_{v}" for v in values], time_levels("_ts", bucket)
    )
    kept = carried.where(F.col("_side") == 1)
    return kept.select(*names, *[F.col(f"_{v}").alias(v) for v in values])
