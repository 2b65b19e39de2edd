"""Daily status report: counts over the last days for the largest categories."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, filters, reshape, sets, sorting


def combined(active: DataFrame, sold: DataFrame, posted: str = "original_post_date") -> DataFrame:
    """Active and sold listings in one frame with the day of posting."""
    both = sets.union_tagged({"base": active, "sold": sold})
    return both.withColumns({"post_day": F.col(posted).cast("date"), "category": F.trim("category")})


def recent_days(today: date, days: int = 10) -> list[str]:
    """The days strictly between today - days and today."""
    return [(today - timedelta(days=d)).isoformat() for d in range(days - 1, 0, -1)]


def largest_recent_categories(rows: DataFrame, today: date, days: int = 10, n: int = 10) -> DataFrame:
    recent = filters.trailing_days(rows, "post_day", F.lit(today), days)
    return sorting.largest_groups(recent, "category", "url", n)


def daily_counts(rows: DataFrame, today: date, days: int = 10, n: int = 10) -> DataFrame:
    """Distinct listings per day and category, of the n largest categories."""
    top = F.broadcast(largest_recent_categories(rows, today, days, n).select("category"))  # n rows
    recent = filters.trailing_days(rows, "post_day", F.lit(today), days).join(top, "category", "left_semi")
    return aggregates.distinct_by_day(recent, "post_day", "category", "url")


def daily_counts_table(rows: DataFrame, today: date, days: int = 10, n: int = 10) -> DataFrame:
    """Categories by days, zeros filled, largest category first."""
    counts = daily_counts(rows, today, days, n).withColumn("day", F.col("post_day").cast("string"))
    wide = reshape.pivot_counts(counts, "category", "day", recent_days(today, days), F.sum("count_ads"))
    return reshape.order_by_row_total(wide, "category")


def counts_by_day(rows: DataFrame, start: str = "2021-10-01", extra: list[str] = ()) -> DataFrame:
    after = rows.where(F.col("post_day") > F.lit(start).cast("date"))
    return aggregates.count_by(after, ["post_day", *extra], "url")


def counts_by_named_category(
    rows: DataFrame, start: str = "2021-10-01", names: tuple[str, ...] = ("Enduro", "Cross Country", "Trail")
) -> DataFrame:
    return aggregates.count_by(filters.trend_rows(rows, "post_day", start, "category", list(names)), ["post_day", "category"], "url")
