"""Listing search: bound parameters, distance limit and the best deals first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import markdown_row
from ..operators.filters import search_ranges
from ..operators.geo import within_distance
from ..operators.sorting import top_k
from ..sources.tables import query

RESULT_COLUMNS = [
    "ad_title", "url", "price", "currency", "last_repost_date", "predicted_price", "predicted_price_diff", "distance_km",
]


def relevant_listings(
    scored: DataFrame,
    price_limit_cad: float,
    min_front_travel: float,
    max_front_travel: float,
    min_rear_travel: float,
    max_rear_travel: float,
    frame_size: str,
    category: str,
    lon: float,
    lat: float,
    distance_km_threshold: float,
    max_results: int = 3,
    nulls: str = "first",
) -> DataFrame:
    """Best deals near a place. Range predicates and the bounding box reach the scan.

    Unpriced listings lead with nulls="first", as the database of record orders them.
    """
    shaped = deals_near(
        scored, price_limit_cad, (min_front_travel, max_front_travel), (min_rear_travel, max_rear_travel), frame_size, category, lon, lat, distance_km_threshold
    )
    return _shown(top_k(shaped, "predicted_price_diff", max_results, nulls, ["url"]))


def deals_near(scored: DataFrame, price_limit_cad, front_travel, rear_travel, frame_size, category, lon, lat, distance_km) -> DataFrame:
    """All listings that a search admits, with their distance and predicted gain; travels are (least, most)."""
    rows = search_ranges(scored, price_limit_cad, front_travel, rear_travel, frame_size, category)
    near = within_distance(rows, "lat", "lon", lat, lon, distance_km)
    return near.withColumn("predicted_price_diff", F.col("predicted_price") - F.col("price"))


def _shown(best: DataFrame) -> DataFrame:
    return best.select(*[F.round(c, 1).alias(c) if c == "distance_km" else F.col(c) for c in RESULT_COLUMNS])


def best_deals_sql(deals: DataFrame, max_results: int) -> DataFrame:
    """The best of the admitted listings by a bound-parameter statement over their view."""
    statement = "SELECT * FROM {deals} ORDER BY predicted_price_diff DESC NULLS FIRST, url LIMIT :n"
    return _shown(query(deals.sparkSession, statement, {"n": max_results}, deals=deals))


def as_markdown(df: DataFrame, limit: int = 1000) -> str:
    """The first ``limit`` rows as a markdown table, or a sentence when there are none."""
    rows = [r[0] for r in df.limit(limit).select(markdown_row(*df.columns)).collect()]
    if not rows:
        return "No bikes found matching your criteria."
    head = "| " + " | ".join(df.columns) + " |"
    return "\n".join([head, "|" + "---|" * len(df.columns), *rows])
