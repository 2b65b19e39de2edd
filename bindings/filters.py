"""P, O and U groups: predicates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import columns as C
from marketloom.operators import aggregates, filters, sets, sorting

from .inputs import Registry, Tables, with_inputs

q = Registry()
KEY = ["order_key"]


@q("p01_equality", with_inputs("select order_key, category_num, region_code from listings where category_num = 3 and region_code = 3"))
def p01(t: Tables):
    return filters.by_category_region(t.listings(), 3, 3).select("order_key", "category_num", "region_code")


@q("p02_plausible_price", with_inputs("select order_key, price from listings where price > 100 and price < 20000 and price not in (123, 1234, 12345)"))
def p02(t: Tables):
    return filters.plausible_price(t.listings()).select("order_key", "price")


@q("p03_forbidden_phrases", with_inputs("select order_key, description from listings where lower(description) not like '%stolen%' and lower(description) not like '%looking for%'"))
def p03(t: Tables):
    return filters.without_phrases(t.listings()).select("order_key", "description")


@q("p04_sold_status", with_inputs("select order_key, 'exact' as rule from listings where still_for_sale like '%Sold%' union all select order_key, 'any case' from listings where lower(still_for_sale) like '%sold%'"))
def p04(t: Tables):
    rows = t.listings()
    exact = filters.sold_only(rows).select("order_key", F.lit("exact").alias("rule"))
    return exact.unionByName(filters.sold_only(rows, ignore_case=True).select("order_key", F.lit("any case").alias("rule")))


BIKES = """select distinct category from listings where lower(category) like '%bike%'
and not regexp_matches(lower(category), 'parts|frames|bags|racks|stands|rims|mx')"""


@q("p05_bike_categories", with_inputs(BIKES + " order by category"))
def p05(t: Tables):
    return filters.bike_categories(t.listings()).orderBy("category")


@q("p06_category_membership", with_inputs(f"select order_key, category from listings where category in ({BIKES})"))
def p06(t: Tables):
    rows = t.listings()
    return filters.in_categories(rows, filters.bike_categories(rows)).select("order_key", "category")


@q("p07_currency", with_inputs("select order_key, currency, 'in' as rule from listings where currency in ('CAD', 'USD') union all select order_key, currency, 'not zl' from listings where currency is distinct from 'zl'"))
def p07(t: Tables):
    rows = t.listings().select("order_key", "currency")
    kept = filters.currency_in(rows, ["CAD", "USD"]).withColumn("rule", F.lit("in"))
    return kept.unionByName(filters.currency_not(rows).withColumn("rule", F.lit("not zl")))


SEARCHABLE = """, searchable as (select *, price as price_cad, coalesce(try_cast(regexp_extract(front_travel, '[0-9]*\\.?[0-9]+') as double), 0) as front,
coalesce(try_cast(regexp_extract(rear_travel, '[0-9]*\\.?[0-9]+') as double), 0) as rear from listings)
"""


def searchable(t: Tables):
    return t.listings().withColumns(
        {
            "price_cad": F.col("price"),
            "front_travel": F.coalesce(C.first_number("front_travel"), F.lit(0.0)),
            "rear_travel": F.coalesce(C.first_number("rear_travel"), F.lit(0.0)),
            "frame_size_normalized": F.trim("frame_size"),
        }
    )


@q("p08_range_predicates", with_inputs(SEARCHABLE + "select order_key from searchable where price_cad < 15000 and front between 100 and 160 and rear between 0 and 150 and trim(frame_size) = '54cm' and category = 'BUILDING Bikes'"))
def p08(t: Tables):
    return filters.search_ranges(searchable(t), 15000, (100, 160), (0, 150), "54cm", "BUILDING Bikes").select("order_key")


HAVERSINE = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians({lat} - ({ref_lat})) / 2), 2) + cos(radians({ref_lat})) * cos(radians({lat})) * pow(sin(radians({lon} - ({ref_lon})) / 2), 2))))"


@q("p09_computed_distance", with_inputs(", d as (select order_key, " + HAVERSINE.format(lat="lat", lon="lon", ref_lat="-10.0", ref_lon="-40.0") + " as km from listings) select order_key, round(km, 6) as distance_km from d where km <= 2500"))
def p09(t: Tables):
    from marketloom.operators.geo import within_distance

    near = within_distance(t.listings(), "lat", "lon", -10.0, -40.0, 2500)
    return near.select("order_key", F.round("distance_km", 6).alias("distance_km"))


@q("p10_rule_text", with_inputs("select order_key from listings where ad_title like '%Norco%' and price < 5000 and currency = 'CAD'"))
def p10(t: Tables):
    return filters.where_rule(t.listings(), "ad_title like '%Norco%' and price < 5000 and currency = 'CAD'").select("order_key")


@q("p11_time_since", with_inputs("select order_key from listings where datetime_scraped > timestamp '1998-03-01 00:00:00'"))
def p11(t: Tables):
    moment = F.lit("1998-03-01 00:00:00").cast("timestamp_ntz")
    return filters.since(t.listings(), "datetime_scraped", moment).select("order_key")


@q("p12_trailing_window", "select event_id from events where cast(ts as date) > date '2024-01-10' and cast(ts as date) < date '2024-01-20'")
def p12(t: Tables):
    rows = t.events.withColumn("day", F.col("ts").cast("date"))
    return filters.trailing_days(rows, "day", F.lit("2024-01-20").cast("date")).select("event_id")


@q("p13_trend_rows", with_inputs("select order_key, category from listings where cast(original_post_date as date) > date '1997-06-01' and (category like '%Enduro%' or category like '%E-Bikes%' or category like '%Frames%')"))
def p13(t: Tables):
    rows = t.listings().withColumn("post_day", F.col("original_post_date").cast("date"))
    return filters.trend_rows(rows, "post_day", "1997-06-01", "category", ["Enduro", "E-Bikes", "Frames"]).select("order_key", "category")


AGE = """, aged as (select *, coalesce(date_diff('day', make_date(cast(nullif(regexp_extract(ad_title || ' ' || description, '((?:19|20)\\d{2})', 1), '') as int), 1, 1), cast(original_post_date as date)), -1000) as age_at_post,
date_diff('day', cast(original_post_date as date), cast(last_repost_date as date)) as days_between_posts,
nullif(trim(regexp_extract(location, ', ([A-Za-z\\s]+)', 1)), '') as country from listings)
"""


def aged(t: Tables):
    return t.listings().withColumns(
        {
            "age_at_post": C.age_at_post("ad_title", "description", "original_post_date"),
            "days_between_posts": C.whole_days("original_post_date", "last_repost_date"),
            "country": C.country_pattern("location"),
        }
    )


@q("p14_modelling_rows", with_inputs(AGE + "select order_key, age_at_post, days_between_posts, country from aged where age_at_post > -365 and days_between_posts < 365 and watch_count is not null and country in ('Canada', 'United States')"))
def p14(t: Tables):
    rows = filters.modelling_rows(aged(t), target="watch_count", countries=["Canada", "United States"])
    return rows.select("order_key", "age_at_post", "days_between_posts", "country")


@q("p15_drop_nulls", with_inputs("select order_key, 'any' as rule from listings where description is not null and currency is not null and watch_count is not null union all select order_key, 'subset' from listings where currency is not null"))
def p15(t: Tables):
    rows = t.listings().select("order_key", "description", "currency", "watch_count")
    every = rows.na.drop("any").select("order_key", F.lit("any").alias("rule"))
    return every.unionByName(rows.na.drop("any", subset=["currency"]).select("order_key", F.lit("subset").alias("rule")))


@q("p16_drop_sparse_columns", "select doc_id, quality from documents left join labels using (doc_id)")
def p16(t: Tables):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return filters.drop_sparse_columns(rows.withColumn("never", F.lit(None).cast("string")), 100)


@q("p17_derived_columns", with_inputs("select order_key as id, price * 2 as double_price, upper(currency) as currency from listings"))
def p17(t: Tables):
    rows = t.listings().select("order_key", "price", "currency")
    out = rows.withColumns({"double_price": F.col("price") * 2, "currency": F.upper("currency")})
    return out.drop("price").withColumnsRenamed({"order_key": "id"})


@q("p18_alert_projection", with_inputs("select url, ad_title, coalesce(description, '0') as description, coalesce(currency, '0') as currency, cast(category_num as string) as category_num from listings"))
def p18(t: Tables):
    return filters.alert_projection(t.listings(), ["url", "ad_title", "description", "currency", "category_num"])


RESID = """, scored as (select order_key, price, price - 6000 as resid, case when region_code = 3 then 'valid' else 'train' end as split from listings)
"""


def residuals(t: Tables):
    return t.listings().select(
        "order_key", "price", (F.col("price") - 6000).alias("resid"),
        F.when(F.col("region_code") == 3, "valid").otherwise("train").alias("split"), "original_post_date",
    )


@q("p19_small_residuals", with_inputs(RESID + "select order_key, resid from scored where split = 'valid' and abs(resid) < 2500"))
def p19(t: Tables):
    return filters.small_residuals(residuals(t)).select("order_key", "resid")


@q("p20_location_format", with_inputs(", l as (select order_key, case when region_code = 3 then location when frame_size is null then 'nowhere' else 'City ,  ' end as loc from listings) select order_key, loc, strpos(loc, ',') > 0 and trim(split_part(loc, ',', 1)) <> '' and trim(substr(loc, strpos(loc, ',') + 1)) <> '' as valid from l"))
def p20(t: Tables):
    loc = F.expr("case when region_code = 3 then location when frame_size is null then 'nowhere' else 'City ,  ' end")
    rows = t.listings().select("order_key", loc.alias("loc"))
    good, bad = filters.split_valid_requests(rows, "loc")
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


# --- ordering ---------------------------------------------------------------


@q("o01_top_k", with_inputs("(select order_key, watch_count from (select order_key, cast(watch_count as bigint) as watch_count from listings) order by watch_count desc nulls first, order_key limit 25)"))
def o01(t: Tables):
    rows = t.listings().select("order_key", F.col("watch_count").cast("bigint").alias("watch_count"))
    return sorting.top_k(rows, "watch_count", 25, "first", ["order_key"])


@q("o02_mixed_sort", with_inputs(", r as (select order_key, currency, price, row_number() over (order by currency desc nulls last, price asc nulls last, order_key) as n from listings) select order_key, currency, price, n from r"))
def o02(t: Tables):
    rows = t.listings().select("order_key", "currency", "price")
    ordered = sorting.sort_mixed(rows, ["currency"], ["price", "order_key"])
    return _numbered(ordered)


def _numbered(ordered):
    """Position in a sorted frame without gathering it: offsets of the sorted partitions plus the place inside."""
    from pyspark.sql.window import Window

    placed = ordered.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return placed.join(offsets, "_part").withColumn("n", F.col("_before") + F.col("_row") + 1).drop("_id", "_part", "_row", "_before")


@q("o03_largest_groups", "select event_type, count(distinct user_id) as n_items from events group by event_type order by n_items desc, event_type limit 10")
def o03(t: Tables):
    return sorting.largest_groups(t.events, "event_type", "user_id")


@q("o05_largest_residuals", with_inputs(RESID + "(select order_key, resid from scored order by abs(resid) desc, order_key limit 20)"))
def o05(t: Tables):
    return sorting.largest_absolute(residuals(t).select("order_key", "resid"), "resid", 20, ["order_key"])


@q("o06_seeded_sample", with_inputs("(select order_key from listings order by md5('42|' || cast(order_key as string)), order_key limit 500)"))
def o06(t: Tables):
    return sorting.sample_n(t.listings().select("order_key"), "order_key", 500)


@q("o07_distinct_sorted", with_inputs("select distinct location from listings order by location"))
def o07(t: Tables):
    return t.listings().select("location").distinct().orderBy("location")


# --- sets ---------------------------------------------------------------------


@q("u10_union_by_name", with_inputs("select url, price, currency, null as condition from previous union all select url, price, null, 'used' from current_ads"))
def u10(t: Tables):
    used = t.current().select("url", "price", F.lit("used").alias("condition"))
    return sets.union_by_name(t.previous().select("url", "price", "currency"), used)


@q("u11_union_tagged", with_inputs("select url, 'base' as type from previous union all select url, 'sold' from sold_store"))
def u11(t: Tables):
    return sets.union_tagged({"base": t.previous().select("url"), "sold": t.sold_store().select("url")})


U12 = """, means as (select region as currency, year, avg(value) as cpi from cpi_raw group by 1, 2),
latest as (select currency, max_by(cpi, year) as most_recent_cpi from means group by 1),
full_series as (select m.currency, m.year, m.cpi, l.most_recent_cpi from means m join latest l using (currency)),
stacked as (select *, 0 as p from full_series union all select currency, 2000, most_recent_cpi, most_recent_cpi, 1 from latest
union all select currency, 2001, most_recent_cpi, most_recent_cpi, 1 from latest)
"""


@q("u12_first_input_wins", with_inputs(U12 + "select currency, year, round(cpi, 4) as cpi, round(most_recent_cpi, 4) as most_recent_cpi from stacked where year <> 2001 qualify row_number() over (partition by currency, year order by p) = 1"))
def u12(t: Tables):
    from marketloom.plans.price_history import cpi_with_current_year

    series = aggregates.yearly_mean_with_latest(t.cpi_raw().withColumnRenamed("region", "currency"), ["currency"], "year", "value")
    out = cpi_with_current_year([series.select("year", "cpi", "most_recent_cpi", "currency")], 2000)
    return out.select("currency", "year", F.round("cpi", 4).alias("cpi"), F.round("most_recent_cpi", 4).alias("most_recent_cpi"))


@q("u13_key_difference", with_inputs("select url from current_ads except select url from previous except select url from sold_store"))
def u13(t: Tables):
    return sets.key_difference(t.current(), t.previous(), t.sold_store(), key="url")


@q("u14_distinct_union", with_inputs("select category from previous union select category from current_ads"))
def u14(t: Tables):
    return sets.distinct_values([t.previous(), t.current()], "category")


@q("u15_distinct_on_subset", "select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) = 1")
def u15(t: Tables):
    from marketloom.operators.windows import latest_row

    rows = latest_row(t.lineitem, "l_orderkey", "l_shipdate", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@q("u16_last_page_wins", "select user_id, max_by(event_type, event_id) as status from events group by user_id")
def u16(t: Tables):
    pages = t.events.withColumn("page_no", F.to_date("ts"))
    return sets.last_page_wins(pages, "user_id", "event_type", ["page_no", "event_id"]).withColumnRenamed("event_type", "status")
