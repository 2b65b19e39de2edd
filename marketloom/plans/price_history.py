"""Historical prices: clean sold listings, adjust for inflation and currency, keep the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..operators import filters, joins, sets, windows


def filled_cpi(cpi: DataFrame, end_year: int) -> DataFrame:
    """Index for every region and year, gaps carried forward. Columns: region, year, cpi, most_recent_cpi."""
    grid = windows.complete_grid(cpi.select("region", "year", "cpi", "most_recent_cpi"), "region", "year", end_year)
    return windows.forward_fill(grid, ["region"], ["year"], ["cpi", "most_recent_cpi"])


def cpi_with_current_year(series: list[DataFrame], current_year: int) -> DataFrame:
    """Stack the series and add the current year at the latest value where a series lacks it."""
    stacked = sets.union_by_name(*series)
    carried = stacked.groupBy("currency").agg(F.max("most_recent_cpi").alias("most_recent_cpi"))
    carried = carried.select(
        F.lit(current_year).alias("year"), F.col("most_recent_cpi").alias("cpi"), "most_recent_cpi", "currency"
    )
    return sets.union_first_wins([stacked.select(carried.columns), carried], ["year", "currency"])


def monthly_rates(fx: DataFrame, wanted: DataFrame, base: str = "CAD") -> DataFrame:
    """Rate for every wanted (month, currency): mean per month, gaps and months past the end carried forward.

    `fx` has (currency, ts, rate); `wanted` has (currency, month). The base currency is 1.
    After the means both sides are calendar-sized.
    """
    monthly = fx.groupBy("currency", C.month_start("ts").alias("month")).agg(F.avg("rate").alias("rate"))
    keys = wanted.select("currency", "month").where("currency is not null and month is not null").distinct()
    marked = keys.withColumn("_wanted", F.lit(True)).join(monthly, ["currency", "month"], "full")
    filled = windows.forward_fill(marked, ["currency"], ["month"], ["rate"])
    one = F.when(F.col("currency") == base, F.lit(1.0)).otherwise(F.col("rate"))
    return filled.where("_wanted").select("currency", "month", one.alias("fx_rate_CAD"))


def rate_calendar(fx: DataFrame, end_year: int) -> DataFrame:
    """Monthly rates per currency from its first month to the end of `end_year`, carried forward.

    The size depends on the calendar and the currencies only, never on the listings.
    """
    monthly = fx.groupBy("currency", C.month_start("ts").alias("month")).agg(F.avg("rate").alias("fx_rate_CAD"))
    spans = monthly.groupBy("currency").agg(F.min("month").alias("_from"))
    months = F.explode(F.sequence("_from", F.lit(f"{end_year}-12-01").cast("date"), F.expr("interval 1 month")))
    grid = spans.select("currency", months.alias("month")).join(monthly, ["currency", "month"], "left")
    return windows.forward_fill(grid, ["currency"], ["month"], ["fx_rate_CAD"])


def normalise_prices(
    sold: DataFrame,
    cpi: DataFrame,
    fx: DataFrame,
    end_year: int,
    bikes_only: bool = True,
    cpi_key: str = "region",
    latest_counts: tuple[str, ...] = ("view_count", "watch_count"),
) -> DataFrame:
    """Sold listings to the modelling table.

    `cpi_key` is "region" (index by the country of the listing) or "currency"
    (two-currency variant). `cpi` has (region or currency, year, cpi, most_recent_cpi).
    """
    rows = filters.sold_only(sold).withColumns(
        {
            "category": F.trim("category"),
            "last_repost_year": F.year("last_repost_date"),
            "last_repost_month": C.month_start("last_repost_date"),
            "price": F.col("price").cast("double"),
            "country": C.country_last_part("location"),
        }
    )
    rows = filters.without_phrases(filters.plausible_price(rows))
    if cpi_key != "region":
        rows = filters.currency_in(rows, ["CAD", "USD"])
    if bikes_only:
        rows = rows.where(filters.names_bikes())
    # The lookups below keep the rows as they are, so the older copies can go first.
    rows = windows.latest_on_both(rows)
    if cpi_key == "region":
        rows = joins.fixed_lookup(rows, fv.COUNTRY_TO_CPI_REGION, "country", "cpi_region")
        index = filled_cpi(cpi, end_year).withColumnsRenamed({"region": "cpi_region", "year": "last_repost_year"})
        keys = ["last_repost_year", "cpi_region"]
    else:
        index = cpi.select(F.col("year").alias("last_repost_year"), "currency", "cpi", "most_recent_cpi")
        keys = ["last_repost_year", "currency"]
    rows = joins.attach_series(rows, index, keys)
    rows = rows.withColumn("price_cpi_adjusted", C.cpi_adjusted("price", "cpi", "most_recent_cpi"))
    rates = rate_calendar(fx.where("currency <> 'CAD'"), end_year).withColumnRenamed("month", "last_repost_month")
    rows = joins.attach_series(rows, rates, ["last_repost_month", "currency"])
    rows = rows.withColumn("fx_rate_CAD", F.when(F.col("currency") == "CAD", 1.0).otherwise(F.col("fx_rate_CAD")))
    rows = rows.withColumns(
        {"fx_month": F.col("last_repost_month"), "price_cpi_adjusted_CAD": F.col("price_cpi_adjusted") * F.col("fx_rate_CAD")}
    )
    return C.objects_to_string(C.convert_to_float(rows, list(latest_counts)))


def historical_sold(raw: DataFrame, restrictions: DataFrame, dates: list[str]) -> DataFrame:
    """Backfilled listings: names, 1:1 join of restrictions, trimmed text, typed dates, sold only."""
    joined = joins.one_to_one(C.normalize_names(raw), C.normalize_names(restrictions), ["url"])
    trimmed = C.trim_strings(joined)
    typed = trimmed.withColumns({c: C.parse_post_date(c) for c in dates})
    return filters.sold_only(typed)
