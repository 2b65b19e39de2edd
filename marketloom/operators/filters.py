"""Predicates over listings."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .rules import RuleError as RuleError
from .rules import rule_column


def by_category_region(df: DataFrame, category_num: int | None = None, region_code: int | None = None) -> DataFrame:
    """Equality filters; -1 or None means all."""
    if category_num not in (None, -1):
        df = df.where(F.col("category_num") == category_num)
    if region_code is not None:
        df = df.where(F.col("region_code") == region_code)
    return df


def plausible_price(df: DataFrame, price: str = "price") -> DataFrame:
    p = F.col(price)
    return df.where((p > fv.PRICE_FLOOR) & (p < fv.PRICE_CEILING) & ~p.isin(fv.JOKE_PRICES))


def without_phrases(df: DataFrame, text: str = "description", phrases: list[str] | None = None) -> DataFrame:
    """Drop rows whose text names a forbidden phrase; null text is dropped too."""
    for phrase in phrases or fv.FORBIDDEN_PHRASES:
        df = df.where(~F.lower(text).contains(phrase))
    return df


def sold_only(df: DataFrame, status: str = "still_for_sale", ignore_case: bool = False) -> DataFrame:
    c = F.lower(status) if ignore_case else F.col(status)
    return df.where(c.contains("sold" if ignore_case else "Sold"))


def names_bikes(category: str = "category") -> Column:
    """The name has "bike" and none of the excluded words, in any case."""
    name = F.lower(category)
    return name.contains("bike") & ~name.rlike("|".join(fv.CATEGORY_EXCLUDED_WORDS))


def bike_categories(df: DataFrame, category: str = "category") -> DataFrame:
    """Distinct names of the bike categories."""
    return df.where(names_bikes(category)).select(category).distinct()


def in_categories(df: DataFrame, categories: DataFrame, category: str = "category") -> DataFrame:
    """Rows of a given set of categories; for the bike categories, `names_bikes` does it without a join."""
    return df.join(categories, category, "left_semi")


def currency_in(df: DataFrame, codes: list[str], currency: str = "currency") -> DataFrame:
    return df.where(F.col(currency).isin(codes))


def currency_not(df: DataFrame, code: str = "zl", currency: str = "currency") -> DataFrame:
    """Drop one currency; rows without currency stay."""
    return df.where(~F.col(currency).eqNullSafe(code))


def search_ranges(
    df: DataFrame,
    price_limit_cad: float,
    front_travel: tuple[float, float],
    rear_travel: tuple[float, float],
    frame_size: str,
    category: str,
) -> DataFrame:
    return df.where(
        (F.col("price_cad") < price_limit_cad)
        & F.col("front_travel").between(*front_travel)
        & F.col("rear_travel").between(*rear_travel)
        & (F.col("frame_size_normalized") == frame_size)
        & (F.col("category") == category)
    )


@contextmanager
def lenient(spark: SparkSession):
    """Within it, expressions are resolved so that a value they cannot handle gives null, not an error."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def rule_predicate(df: DataFrame, text: str) -> Column:
    """Column for a saved condition; raises RuleError when it is not allowed or does not resolve."""
    return rule_column(df, text)


def where_rule(df: DataFrame, text: str) -> DataFrame:
    with lenient(df.sparkSession):
        return df.where(rule_predicate(df, text))


def since(df: DataFrame, ts: str, moment: Column) -> DataFrame:
    return df.where(F.col(ts) > moment)


def trailing_days(df: DataFrame, day: str, today: Column, days: int = 10) -> DataFrame:
    """Strictly between today - days and today."""
    d = F.col(day)
    return df.where((d > F.date_sub(today, days)) & (d < today))


def trend_rows(df: DataFrame, day: str, start: str, category: str, names: list[str]) -> DataFrame:
    """After a start date and any of the names (case-sensitive) in the category."""
    hit = F.lit(False)
    for name in names:
        hit = hit | F.col(category).contains(name)
    return df.where((F.col(day) > F.lit(start).cast("date")) & hit)


def modelling_rows(
    df: DataFrame,
    age: str = "age_at_post",
    gap: str = "days_between_posts",
    target: str = "price_cpi_adjusted_CAD",
    countries: list[str] | None = None,
) -> DataFrame:
    out = df.where((F.col(age) > -365) & (F.col(gap) < 365) & F.col(target).isNotNull())
    return out.where(F.col("country").isin(countries)) if countries else out


def drop_sparse_columns(df: DataFrame, threshold: int = 100) -> DataFrame:
    """Keep columns with at least `threshold` non-null values, found in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select([c for c in df.columns if counts[c] >= threshold])


def alert_projection(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mail columns as text, null shown as 0."""
    names = columns or fv.ALERT_COLUMNS
    return df.select([F.col(c).cast("string").alias(c) for c in names]).na.fill("0")


def small_residuals(df: DataFrame, resid: str = "resid", split: str = "split", limit: float = 2500) -> DataFrame:
    return df.where((F.col(split) == "valid") & (F.abs(resid) < limit))


def location_is_valid(location: str = "location") -> Column:
    """A comma with something other than blanks on both sides."""
    parts = F.split(F.col(location), ",", 2)
    city = F.trim(F.try_element_at(parts, F.lit(1)))
    country = F.trim(F.try_element_at(parts, F.lit(2)))
    return F.coalesce((city != "") & (country != ""), F.lit(False))


def split_valid_requests(df: DataFrame, location: str = "location") -> tuple[DataFrame, DataFrame]:
    ok = location_is_valid(location)
    return df.where(ok), df.where(~ok)
