"""Counts, trends, shares and error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import country_last_part, month_start
from .windows import with_group_total


def count_by(df: DataFrame, keys: list[str], counted: str | None = None, name: str = "count_ads") -> DataFrame:
    """Rows per group, or non-null values of one column."""
    return df.groupBy(*keys).agg(F.count(F.lit(1) if counted is None else F.col(counted)).alias(name))


def count_by_category(df: DataFrame, category: str = "category", counted: str = "original_post_date") -> DataFrame:
    return count_by(df, [category], counted).orderBy(F.desc("count_ads"), category)


def count_by_country_currency(df: DataFrame, location: str = "location", currency: str = "currency", n: int = 30) -> DataFrame:
    counted = count_by(df.select(country_last_part(location).alias("country"), currency).na.drop(), ["country", currency])
    return counted.orderBy(F.desc("count_ads"), "country", currency).limit(n)


def fill_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Non-null count per column, one pass, as (field, n_filled)."""
    names = columns or df.columns
    row = df.agg(*[F.count(c).alias(c) for c in names])
    return row.unpivot([], names, "field", "n_filled")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.orderBy(F.desc("n_rows"), column).limit(n)


def in_top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose value is one of the n most frequent; the n values are broadcast."""
    return df.join(F.broadcast(top_values(df, column, n).select(column)), column, "left_semi")


def monthly_trend(df: DataFrame, date: str, category: str, price: str, n: int | None = None) -> DataFrame:
    """Mean price and number of rows per month and category, of the n largest categories."""
    rows = in_top_values(df, category, n) if n else df
    return rows.groupBy(month_start(date).alias("month_start"), category).agg(
        F.avg(price).alias("mean_price"), F.count(F.lit(1)).alias("count_ads")
    )


def seasonal_counts(df: DataFrame, date: str, category: str) -> DataFrame:
    return df.groupBy(F.month(date).alias("month"), F.year(date).alias("year"), category).agg(
        F.count(F.lit(1)).alias("count_ads")
    )


def mean_prices(df: DataFrame, keys: list[str], prices: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(p).alias(f"mean_{p}") for p in prices])


def mean_with_interval(df: DataFrame, keys: list[str], value: str, min_rows: int = 10) -> DataFrame:
    """Mean with a normal 95 % interval per group, groups above `min_rows` rows only."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_filled"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    half = F.lit(1.96) * F.col("_sd") / F.sqrt("_filled")
    out = stats.where(F.col("n_rows") > min_rows)
    return out.withColumns({"ci_low": F.col("mean_value") - half, "ci_high": F.col("mean_value") + half}).drop("_sd", "_filled")


def share_within(df: DataFrame, group: list[str], part: str, counted: str) -> DataFrame:
    """Share of each part within its group, from counts."""
    counts = df.groupBy(*group, part).agg(F.count(counted).alias("n_rows"))
    totals = with_group_total(counts, group, F.sum("n_rows"), "n_group")
    return totals.withColumn("fraction", F.col("n_rows") / F.col("n_group"))


def distinct_by_day(df: DataFrame, day: str, category: str, item: str) -> DataFrame:
    return df.groupBy(day, category).agg(F.countDistinct(item).alias("count_ads"))


def yearly_mean_with_latest(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Yearly mean, and on every row the mean of the latest year that has one."""
    means = df.groupBy(*keys, year).agg(F.avg(value).alias("cpi"))
    latest = F.max_by("cpi", F.when(F.col("cpi").isNotNull(), F.col(year)))
    if not keys:
        return means.withColumn("most_recent_cpi", means.agg(latest).scalar())
    return with_group_total(means, keys, latest, "most_recent_cpi")


def mean_of_duplicates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def fill_share_by_month(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    filled = [F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_has_value") for c in columns]
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("year_month")).agg(*filled)


def unique_values_with_example(df: DataFrame, column: str, url: str, counted: str, n: int = 10) -> DataFrame:
    """Distinct values with one example url (the smallest) and a count, most frequent first."""
    grouped = df.where(F.col(column).isNotNull()).groupBy(column)
    out = grouped.agg(F.min(url).alias("example_url"), F.count(counted).alias("n_rows"))
    return out.orderBy(F.desc("n_rows"), column).limit(n)


def compare_predictions_by_month(df: DataFrame, date: str, pred: str = "pred", old: str = "old_pred", resid: str = "resid") -> DataFrame:
    return df.groupBy(F.date_format(date, "yyyy-MM").alias("year_month")).agg(
        F.avg(F.col(pred) - F.col(old)).alias("mean_diff_in_pred"),
        F.avg(resid).alias("mean_resid"),
        F.count(resid).alias("n_rows"),
    )


def histogram(df: DataFrame, groups: list[str], value: str, width: float) -> DataFrame:
    """Rows per fixed-width bin and group; the table behind a density chart."""
    low = F.floor(F.col(value) / F.lit(float(width))) * F.lit(float(width))
    binned = df.where(F.col(value).isNotNull()).groupBy(*groups, low.cast("double").alias("bin_low"))
    return binned.agg(F.count(F.lit(1)).alias("n_rows"))


def quantiles(df: DataFrame, groups: list[str], value: str, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Sketch quantiles per group; sketches merge on the map side and stay small."""
    sketch = df.groupBy(*groups).agg(F.percentile_approx(value, list(at), 10_000).alias("_q"))
    return sketch.select(*groups, *[F.col("_q")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(at)])


def error_metrics(df: DataFrame, actual: str, predicted: str, groups: list[str] = ()) -> DataFrame:
    """MAPE and RMSE, with a floor on the actual value like the usual library definition."""
    floor = F.lit(2.220446049250313e-16)
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*groups).agg(
        F.avg(F.abs(error) / F.greatest(F.abs(actual), floor)).alias("mape"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(error).alias("n_rows"),
    )


def flag_counts(df: DataFrame, flag: str) -> DataFrame:
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("n_rows"))


def linear_fit(df: DataFrame, x: str, y: str, groups: list[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("correlation")
    )
