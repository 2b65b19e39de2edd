"""A and R groups: counts, trends, metrics, reports and reshaping."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketloom.operators import aggregates, joins, reshape, sorting
from marketloom.plans import reports

from .inputs import Registry, Tables, with_inputs

q = Registry()


@q("a01_count_by_category", with_inputs("select category, count(original_post_date) as count_ads from listings group by 1 order by 2 desc, 1"))
def a01(t: Tables):
    return aggregates.count_by_category(t.listings())


@q("a02_count_by_country_currency", with_inputs("select trim(split_part(location, ',', 2)) as country, currency, count(*) as count_ads from listings where currency is not null group by 1, 2 order by 3 desc, 1, 2 limit 30"))
def a02(t: Tables):
    return aggregates.count_by_country_currency(t.listings())


@q("a03_fill_counts", with_inputs("unpivot (select count(description) as description, count(currency) as currency, count(frame_size) as frame_size, count(watch_count) as watch_count, count(price) as price from listings) on columns(*) into name field value n_filled"))
def a03(t: Tables):
    return aggregates.fill_counts(t.listings(), ["description", "currency", "frame_size", "watch_count", "price"])


@q("a04_value_counts", with_inputs("select category, count(*) as n_rows from listings group by 1 order by 2 desc, 1 limit 5"))
def a04(t: Tables):
    return aggregates.top_values(t.listings(), "category", 5)


@q("a05_monthly_trend", with_inputs(", top as (select category from listings group by 1 order by count(*) desc, 1 limit 10) select strftime(date_trunc('month', last_repost_date), '%Y-%m-%d') as month_start, category, round(avg(price), 4) as mean_price, count(*) as count_ads from listings where category in (from top) group by 1, 2"))
def a05(t: Tables):
    out = aggregates.monthly_trend(t.listings(), "last_repost_date", "category", "price", 10)
    return out.select(F.col("month_start").cast("string").alias("month_start"), "category", F.round("mean_price", 4).alias("mean_price"), "count_ads")


@q("a06_seasonal_counts", with_inputs("select month(last_repost_date) as month, year(last_repost_date) as year, category, count(*) as count_ads from listings group by 1, 2, 3"))
def a06(t: Tables):
    return aggregates.seasonal_counts(t.listings(), "last_repost_date", "category")


@q("a07_mean_prices", with_inputs("select strftime(last_repost_date, '%Y-%m') as year_month, region_code, round(avg(price), 4) as mean_price, round(avg(price * 2), 4) as mean_price_cpi_adjusted from listings group by 1, 2"))
def a07(t: Tables):
    rows = t.listings().withColumns({"year_month": F.date_format("last_repost_date", "yyyy-MM"), "price_cpi_adjusted": F.col("price") * 2})
    out = aggregates.mean_prices(rows, ["year_month", "region_code"], ["price", "price_cpi_adjusted"])
    return out.select("year_month", "region_code", *[F.round(c, 4).alias(c) for c in ("mean_price", "mean_price_cpi_adjusted")])


@q("a08_mean_with_interval", with_inputs("select year(last_repost_date) as year, month(last_repost_date) as month, count(*) as n_rows, round(avg(price), 4) as mean_value, round(avg(price) - 1.96 * stddev_samp(price) / sqrt(count(price)), 4) as ci_low, round(avg(price) + 1.96 * stddev_samp(price) / sqrt(count(price)), 4) as ci_high from listings group by 1, 2 having count(*) > 10"))
def a08(t: Tables):
    rows = t.listings().select("price", F.year("last_repost_date").alias("year"), F.month("last_repost_date").alias("month"))
    out = aggregates.mean_with_interval(rows, ["year", "month"], "price")
    return out.select("year", "month", "n_rows", *[F.round(c, 4).alias(c) for c in ("mean_value", "ci_low", "ci_high")])


@q("a09_share_within_month", with_inputs("select strftime(last_repost_date, '%Y-%m') as year_month, currency, count(category) as n_rows, sum(count(category)) over (partition by strftime(last_repost_date, '%Y-%m'))::bigint as n_group, round(count(category) / sum(count(category)) over (partition by strftime(last_repost_date, '%Y-%m')), 8) as fraction from listings where currency is not null group by 1, 2"))
def a09(t: Tables):
    rows = t.listings().where("currency is not null").withColumn("year_month", F.date_format("last_repost_date", "yyyy-MM"))
    return aggregates.share_within(rows, ["year_month"], "currency", "category").withColumn("fraction", F.round("fraction", 8))


@q("a10_nested_catalogue", "with m as (select p_size, p_brand, string_agg(p_name, ',' order by p_name) as models from (select distinct p_size, p_brand, p_name from part) group by 1, 2) select p_size, string_agg(p_brand || ':' || models, ';' order by p_brand) as catalogue from m group by 1")
def a10(t: Tables):
    nested = reshape.nested_catalogue(t.part, "p_size", "p_brand", "p_name")
    entries = F.transform(F.map_entries("makers"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ",")))
    return nested.select("p_size", F.array_join(entries, ";").alias("catalogue"))


DAYS = "cast(cast(ts as date) as string)"


@q("a11_distinct_by_day", f"select {DAYS} as day, event_type, count(distinct user_id) as count_ads from events group by 1, 2")
def a11(t: Tables):
    rows = t.events.withColumn("day", F.to_date("ts").cast("string"))
    return aggregates.distinct_by_day(rows, "day", "event_type", "user_id")


@q("a12_counts_by_day", with_inputs(", combined_rows as (select *, 'base' as type from previous union all select *, 'sold' as type from sold_store) select cast(cast(original_post_date as date) as string) as post_day, type, count(url) as count_ads from combined_rows where cast(original_post_date as date) > date '1996-10-01' group by 1, 2"))
def a12(t: Tables):
    out = reports.counts_by_day(reports.combined(t.previous(), t.sold_store()), "1996-10-01", ["type"])
    return out.withColumn("post_day", F.col("post_day").cast("string"))


@q("a12_counts_by_category", with_inputs(", combined_rows as (select * from previous union all select * from sold_store) select cast(cast(original_post_date as date) as string) as post_day, trim(category) as category, count(url) as count_ads from combined_rows where cast(original_post_date as date) > date '1996-10-01' and (category like '%Enduro%' or category like '%Cross Country%' or category like '%Trail%') group by 1, 2"))
def a12_category(t: Tables):
    out = reports.counts_by_named_category(reports.combined(t.previous(), t.sold_store()), "1996-10-01")
    return out.withColumn("post_day", F.col("post_day").cast("string"))


@q("a13_yearly_mean_latest", with_inputs(", m as (select region, year, avg(value) as cpi from cpi_raw group by 1, 2) select region, year, round(cpi, 4) as cpi, round(max_by(cpi, year) over (partition by region), 4) as most_recent_cpi from m"))
def a13(t: Tables):
    out = aggregates.yearly_mean_with_latest(t.cpi_raw(), ["region"], "year", "value")
    return out.select("region", "year", F.round("cpi", 4).alias("cpi"), F.round("most_recent_cpi", 4).alias("most_recent_cpi"))


@q("a14_mean_of_duplicates", with_inputs("select currency, strftime(ts, '%Y-%m') as month, round(avg(rate), 8) as rate from fx_raw group by 1, 2"))
def a14(t: Tables):
    rows = t.fx().withColumn("month", F.date_format("ts", "yyyy-MM"))
    return aggregates.mean_of_duplicates(rows, ["currency", "month"], "rate").withColumn("rate", F.round("rate", 8))


@q("a15_fill_share_by_month", with_inputs("select strftime(original_post_date, '%Y-%m') as year_month, round(avg(case when description is not null then 1.0 else 0 end), 8) as description_has_value, round(avg(case when watch_count is not null then 1.0 else 0 end), 8) as watch_count_has_value from listings group by 1"))
def a15(t: Tables):
    out = aggregates.fill_share_by_month(t.listings(), "original_post_date", ["description", "watch_count"])
    return out.select("year_month", *[F.round(c, 8).alias(c) for c in ("description_has_value", "watch_count_has_value")])


@q("a16_unique_values", with_inputs("select frame_size, min(url) as example_url, count(currency) as n_rows from listings where frame_size is not null group by 1 order by 3 desc, 1 limit 10"))
def a16(t: Tables):
    return aggregates.unique_values_with_example(t.listings(), "frame_size", "url", "currency")


PREDICTED = """, predicted as (select *, o_pred + 250 as pred, o_pred as old_pred, price - (o_pred + 250) as resid from
(select *, lat * 100 + 5000 as o_pred from listings))
"""


def predicted(t: Tables):
    """Listings with two simple predictions."""
    base = F.col("lat") * 100 + 5000
    rows = t.listings().withColumns({"old_pred": base, "pred": base + 250})
    return rows.withColumn("resid", F.col("price") - F.col("pred"))


@q("a17_compare_models", with_inputs(PREDICTED + "select strftime(original_post_date, '%Y-%m') as year_month, round(avg(pred - old_pred), 4) as mean_diff_in_pred, round(avg(resid), 4) as mean_resid, count(resid) as n_rows from predicted group by 1"))
def a17(t: Tables):
    out = aggregates.compare_predictions_by_month(predicted(t), "original_post_date")
    return out.select("year_month", F.round("mean_diff_in_pred", 4).alias("mean_diff_in_pred"), F.round("mean_resid", 4).alias("mean_resid"), "n_rows")


@q("a18_residual_histogram", with_inputs(PREDICTED + "select category, floor(resid / 500) * 500 as bin_low, count(*) as n_rows from predicted group by 1, 2"))
def a18(t: Tables):
    return aggregates.histogram(predicted(t), ["category"], "resid", 500)


@q("a18_residual_quantiles")
def a18_quantiles(t: Tables):
    return aggregates.quantiles(predicted(t), ["category"], "resid")


@q("a19_error_metrics", with_inputs(PREDICTED + "select region_code, round(avg(abs(price - pred) / greatest(abs(price), 2.220446049250313e-16)), 6) as mape, round(sqrt(avg((price - pred) * (price - pred))), 4) as rmse, count(price - pred) as n_rows from predicted group by 1"))
def a19(t: Tables):
    out = aggregates.error_metrics(predicted(t), "price", "pred", ["region_code"])
    return out.select("region_code", F.round("mape", 6).alias("mape"), F.round("rmse", 4).alias("rmse"), "n_rows")


@q("a20_mode_and_median", "select (select mode_value from (select p_size as mode_value, count(*) from part group by 1 order by 2 desc, 1 limit 1)) as mode_value, (select median(o_totalprice) from orders) as median_value")
def a20(t: Tables):
    top = sorting.mode_value(t.part, "p_size").select(F.col("p_size").alias("mode_value"))
    return top.withColumn("median_value", F.lit(sorting.exact_median(t.orders, "o_totalprice")))


@q("a21_flag_counts", with_inputs(PREDICTED + "select resid < -6000 as flag, count(*) as n_rows from predicted group by 1"))
def a21(t: Tables):
    return aggregates.flag_counts(predicted(t).withColumn("flag", F.col("resid") < -6000), "flag")


@q("a22_duplicate_keys", "select user_id, event_type, count(*) as count from events group by 1, 2 having count(*) > 1")
def a22(t: Tables):
    return joins.duplicate_keys(t.events, ["user_id", "event_type"])


@q("a23_linear_fit", with_inputs("select region_code, round(regr_slope(price, lat), 4) as slope, round(regr_intercept(price, lat), 3) as intercept, round(corr(lat, price), 6) as correlation from listings group by 1"))
def a23(t: Tables):
    out = aggregates.linear_fit(t.listings(), "lat", "price", ["region_code"])
    return out.select("region_code", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("correlation", 6).alias("correlation"))


SPLIT = "case when h < 70 then 'train' when h < 85 then 'valid' else 'test' end"
SPLITS = """, hashed as (select *, cast('0x' || substr(md5('42|' || cast(order_key as string)), 1, 8) as bigint) % 100 as h from listings),
split_rows as (select *, """ + SPLIT + " as split from hashed)\n"


@q("a24_price_by_split", with_inputs(SPLITS + "select split, floor(price / 1000) * 1000 as bin_low, count(*) as n_rows from split_rows group by 1, 2"))
def a24(t: Tables):
    from marketloom.operators.features import split_column

    return aggregates.histogram(t.listings().withColumn("split", split_column("order_key")), ["split"], "price", 1000)


# --- reshape and report -----------------------------------------------------------


BOTH = """, combined_rows as (select url, trim(category) as category, cast(original_post_date as date) as post_day from previous union all select url, trim(category), cast(original_post_date as date) from sold_store),
recent as (select * from combined_rows where post_day > date '1998-06-15' - interval 10 day and post_day < date '1998-06-15'),
top as (select category from recent group by 1 order by count(distinct url) desc, 1 limit 10),
counts as (select post_day, category, count(distinct url) as count_ads from recent where category in (from top) group by 1, 2)
"""
TODAY = date(1998, 6, 15)
_DAY_COLUMNS = ", ".join(f"coalesce(sum(count_ads) filter (post_day = date '{d}'), 0)::bigint as \"{d}\"" for d in reports.recent_days(TODAY))


def _report(t: Tables):
    return reports.combined(t.previous(), t.sold_store())


@q("r01_daily_counts_table", with_inputs(BOTH + f"select category, {_DAY_COLUMNS} from counts group by 1"))
def r01(t: Tables):
    return reports.daily_counts_table(_report(t), TODAY).drop("row_total")


@q("o04_ordered_by_row_total", with_inputs(BOTH + "select category, sum(count_ads)::bigint as row_total from counts group by 1 order by 2 desc, 1"))
def o04(t: Tables):
    return reports.daily_counts_table(_report(t), TODAY).select("category", "row_total")


@q("o03_largest_categories", with_inputs(BOTH + "select category, count(distinct url) as n_items from recent group by 1 order by 2 desc, 1 limit 10"))
def o03_report(t: Tables):
    return reports.largest_recent_categories(_report(t), TODAY)


@q("r02_month_by_currency", with_inputs("select strftime(last_repost_date, '%Y-%m') as year_month, count(*) filter (currency = 'CAD') as CAD, count(*) filter (currency = 'USD') as USD, count(*) filter (currency = 'EUR') as EUR from listings group by 1"))
def r02(t: Tables):
    rows = t.listings().withColumn("year_month", F.date_format("last_repost_date", "yyyy-MM"))
    return reshape.pivot_counts(rows, "year_month", "currency", ["CAD", "USD", "EUR"], F.count(F.lit(1)))


WIDE = ["1995", "1996", "1997", "1998"]


@q("r03_melt_years", with_inputs(", w as (select region, year, round(avg(value), 4) as cpi from cpi_raw where year between 1995 and 1998 group by 1, 2) select r.region, cast(y.y as string) as year, w.cpi from (select distinct region from cpi_raw) r cross join (values (1995), (1996), (1997), (1998)) y(y) left join w on w.region = r.region and w.year = y.y"))
def r03(t: Tables):
    yearly = t.cpi_raw().withColumn("year", F.col("year").cast("string"))
    wide = yearly.groupBy("region").pivot("year", WIDE).agg(F.round(F.avg("value"), 4))
    return reshape.melt(wide, ["region"], "year", "cpi", WIDE)


def part_labels(t: Tables):
    """Label/value rows of two tables per part."""
    def pair(table: int, label: str, value):
        return F.struct(F.lit(table).alias("table_no"), F.lit(label).alias("label"), value.alias("value"))

    pairs = F.array(
        pair(0, "Brand", F.col("p_brand")),
        pair(0, "Type", F.col("p_type")),
        pair(1, "Brand", F.concat("p_brand", F.lit(" works"))),
        pair(1, "Size", F.col("p_size").cast("string")),
    )
    return t.part.select("p_partkey", F.inline(pairs))


@q("r04_labels_to_row", "select p_partkey, p_brand || ' works' as Brand, p_brand as Brand_summary, cast(p_size as string) as Size, p_type as Type_summary from part")
def r04(t: Tables):
    long = reshape.suffix_labels(part_labels(t))
    return reshape.label_values_to_row(long, "p_partkey", ["Brand", "Brand_summary", "Size", "Type_summary"])


@q("r05_suffix_first_table", "select p_partkey, 'Brand_summary' as label, p_brand as value from part union all select p_partkey, 'Type_summary', p_type from part union all select p_partkey, 'Brand', p_brand || ' works' from part union all select p_partkey, 'Size', cast(p_size as string) from part")
def r05(t: Tables):
    return reshape.suffix_labels(part_labels(t)).select("p_partkey", "label", "value")


@q("r04_labels_to_map", "select p_partkey, 'Brand=' || p_brand || ';Type=' || p_type as entries from part")
def r04_map(t: Tables):
    maps = reshape.label_values_to_map(part_labels(t).where("table_no = 0"), "p_partkey")
    return maps.select("p_partkey", F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries"))


@q("r06_nested_map_rows", "select distinct p_size, p_brand, p_name from part")
def r06(t: Tables):
    nested = reshape.nested_catalogue(t.part, "p_size", "p_brand", "p_name")
    return reshape.flatten_catalogue(nested, "p_size", "p_brand", "p_name")
