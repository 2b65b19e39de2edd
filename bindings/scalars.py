"""F group: scalar functions, and the UDF surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import columns as C
from marketloom.functions import fixed_values as fv
from marketloom.functions.similarity import ascii_fold, partial_ratio_udf
from marketloom.plans.scored import convert_currency

from .inputs import Registry, Tables, with_inputs

q = Registry()


@q("f01_convert_to_float", with_inputs("select order_key, cast(nullif(regexp_replace(coalesce(price_text, '0'), '[^0-9.]', '', 'g'), '') as double) as price_text, cast(regexp_replace(view_count, '[^0-9.]', '', 'g') as double) as view_count from listings where regexp_replace(coalesce(price_text, '0'), '[^0-9.]', '', 'g') <> ''"))
def f01(t: Tables):
    return C.convert_to_float(t.listings().select("order_key", "price_text", "view_count"), ["price_text", "view_count"])


@q("f02_objects_to_string", "select vec_id, len(embedding)::int as n_values, true as is_text from embeddings")
def f02(t: Tables):
    sized = t.embeddings.select("vec_id", F.size("embedding").alias("n_values"), "embedding")
    out = C.objects_to_string(sized)
    return out.select("vec_id", "n_values", F.col("embedding").startswith("[").alias("is_text"))


@q("f03_trim_strings", with_inputs("select order_key, trim(frame_size) as frame_size, trim(material) as material from listings"))
def f03(t: Tables):
    return C.trim_strings(t.listings().select("order_key", "frame_size", "material"))


@q("f04_collapse_whitespace", "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as digest from documents")
def f04(t: Tables):
    return t.documents.select("doc_id", F.md5(C.collapse_whitespace("text")).alias("digest"))


@q("f05_country_last_part", with_inputs("select order_key, trim(split_part(location, ',', -1)) as country from listings"))
def f05(t: Tables):
    return t.listings().select("order_key", C.country_last_part("location").alias("country"))


@q("f06_country_pattern", with_inputs("select order_key, nullif(regexp_extract(location, ', ([A-Za-z\\s]+)', 1), '') as country from listings"))
def f06(t: Tables):
    return t.listings().select("order_key", C.country_pattern("location").alias("country"))


@q("f07_known_country", with_inputs("select order_key, nullif(regexp_extract(location, '(Canada|United States|United Kingdom)', 1), '') as country from listings"))
def f07(t: Tables):
    return t.listings().select("order_key", C.known_country("location").alias("country"))


@q("f08_model_year", with_inputs("select order_key, nullif(regexp_extract(ad_title || ': ' || description, '((?:19|20)\\d{2})', 1), '') as model_year from listings"))
def f08(t: Tables):
    return t.listings().select("order_key", C.model_year("ad_title", "description", ": ").alias("model_year"))


@q("f09_remove_years", with_inputs("select order_key, regexp_replace(ad_title, '((?:19|20)\\d{2})', '', 'g') as title from listings"))
def f09(t: Tables):
    return t.listings().select("order_key", C.remove_years("ad_title").alias("title"))


PRICE_LABEL = "cast(cast(floor(price / 10) as bigint) as string) || ',' || '500 ' || coalesce(currency, '?')"


@q("f10_price_and_currency", with_inputs(f", p as (select order_key, {PRICE_LABEL} as label from listings) select order_key, try_cast(replace(regexp_extract(label, '([\\d,]+)\\s*([A-Za-z]{{1,3}})', 1), ',', '') as double) as price, nullif(regexp_extract(label, '([\\d,]+)\\s*([A-Za-z]{{1,3}})', 2), '') as currency from p"))
def f10(t: Tables):
    rows = t.listings().select("order_key", F.expr(PRICE_LABEL).alias("label"))
    return rows.select("order_key", *[v.alias(k) for k, v in C.price_and_currency("label").items()])


SYMBOLS = "case currency when 'CAD' then 'C$ ' || cast(cast(floor(price) as bigint) as string) || ',50' when 'USD' then '$1.' || cast(cast(floor(price) as bigint) as string) when 'EUR' then cast(cast(floor(price) as bigint) as string) || '.000,5 €' else 'free' end"


@q("f11_symbol_price", with_inputs(f", p as (select order_key, {SYMBOLS} as label, currency from listings) select order_key, case when label = 'free' then null else translate(regexp_extract(label, '(\\d[\\d.,]*)', 1), '.,', '') end as price, case when label = 'free' then null when currency = 'CAD' then 'C$' else currency end as currency from p"))
def f11(t: Tables):
    rows = t.listings().select("order_key", F.expr(SYMBOLS).alias("label"))
    return rows.select("order_key", *[v.alias(k) for k, v in C.symbol_price("label").items()])


@q("f12_first_number", with_inputs("select order_key, nullif(try_cast(nullif(regexp_extract(front_travel, '\\d*\\.?\\d+'), '') as double), 0) as front, coalesce(nullif(try_cast(nullif(regexp_extract(rear_travel, '\\d*\\.?\\d+'), '') as double), 0), 0) as rear from listings"))
def f12(t: Tables):
    return t.listings().select("order_key", C.first_number("front_travel").alias("front"), F.coalesce(C.first_number("rear_travel"), F.lit(0.0)).alias("rear"))


MSRP = "case when p_size < 20 then '$2,' || cast(100 + p_size as string) when p_size < 40 then 'costs about $3,' || cast(100 + p_size as string) || ' new' else 'unknown' end"


@q("f13_list_price", "select p_partkey, case when p_size < 20 then 2100.0 + p_size when p_size < 40 then 3100.0 + p_size end::double as msrp from part")
def f13(t: Tables):
    return t.part.select("p_partkey", C.list_price(F.expr(MSRP)).alias("msrp"))


TRAVEL = "cast(100 + p_size as string) || 'mm front, ' || cast(p_size as string) || 'mm ' || case when p_size < 25 then 'rear' else 'seat' end || ' and ' || cast(p_size as string) || '.5 kg'"


@q("f14_matched_number", "select p_partkey, (100 + p_size)::double as front, case when p_size < 25 then p_size else 0 end::double as rear, p_size + 0.5::double as weight from part")
def f14(t: Tables):
    text = F.expr(TRAVEL)
    return t.part.select(
        "p_partkey", C.matched_number(text, fv.FRONT_TRAVEL_PATTERN).alias("front"),
        C.matched_number(text, fv.REAR_TRAVEL_PATTERN).alias("rear"), C.matched_number(text, fv.WEIGHT_PATTERN).alias("weight"),
    )


@q("f15_url_parts", "select p_partkey, p_brand as manufacturer, cast(2000 + p_size as string) as year, replace(p_name, ' ', '-') || '-' || cast(p_partkey as string) as model from part")
def f15(t: Tables):
    from .joins import spec_rows

    return spec_rows(t).select("p_partkey", *[v.alias(k) for k, v in C.spec_url_parts("spec_url").items()])


@q("f16_composite_key", "select p_partkey, cast(2000 + p_size as string) || ' ' || p_brand || ' ' || lower(replace(p_name, '-', ' ')) as bike from part")
def f16(t: Tables):
    year = (F.lit(2000) + F.col("p_size")).cast("string")
    return t.part.select("p_partkey", C.catalogue_key(year, "p_brand", "p_name").alias("bike"))


@q("f17_plain_name", "select doc_id, md5(regexp_replace(strip_accents(replace(replace(lower(text), ' ', ''), '-', '')), '[^\\x00-\\x7F]', '', 'g')) as digest from documents")
def f17(t: Tables):
    return t.documents.select("doc_id", F.md5(C.plain_name("text")).alias("digest"))


@q("f18_currency_code", with_inputs("select order_key, case currency when 'USD' then 'USD' when 'GBP' then 'GBP' when 'EUR' then 'EUR' when 'CAD' then 'CAD' else currency end as code from listings"))
def f18(t: Tables):
    symbol = F.expr("case currency when 'USD' then '$' when 'GBP' then '£' when 'EUR' then '€' when 'CAD' then 'C$' else currency end")
    return t.listings().select("order_key", C.currency_code(symbol).alias("code"))


@q("f19_fixed_rate_cad", with_inputs("select order_key, price * case currency when 'USD' then 1.25 when 'GBP' then 1.74 when 'EUR' then 1.49 when 'CAD' then 1.0 end::double as price_cad from listings"))
def f19(t: Tables):
    return t.listings().select("order_key", C.fixed_rate_cad("price", "currency").alias("price_cad"))


SPOT = ", spot as (select currency, avg(rate) as rate_to_cad from fx_raw group by 1)\n"


def spot_rates(t: Tables):
    return t.fx().groupBy("currency").agg(F.avg("rate").alias("rate_to_cad"))


@q("f20_rate_table", with_inputs(SPOT + "select order_key, round(case when l.currency = 'CAD' then price else price * rate_to_cad end, 6) as price_cad, round(case when l.currency = 'CAD' then price else price / rate_to_cad end, 6) as price_back from listings l left join spot s on l.currency = s.currency"))
def f20(t: Tables):
    rows = convert_currency(t.listings().select("order_key", "price", "currency"), "price", "currency", spot_rates(t), "price_cad")
    rows = convert_currency(rows, "price", "currency", spot_rates(t), "price_back", to_cad=False)
    return rows.select("order_key", F.round("price_cad", 6).alias("price_cad"), F.round("price_back", 6).alias("price_back"))


@q("f21_cpi_adjusted", with_inputs("select order_key, price * (nullif(region_code * 40.5, 0) / (category_num + 100)) as adjusted from listings"))
def f21(t: Tables):
    rows = t.listings()
    latest, cpi = F.col("region_code") * F.lit(40.5), (F.col("category_num") + 100).cast("double")
    return rows.select("order_key", C.cpi_adjusted("price", cpi, latest).alias("adjusted"))


@q("f22_fx_adjusted", with_inputs("select order_key, price * 1.5 * lat as adjusted from listings"))
def f22(t: Tables):
    return t.listings().select("order_key", (F.col("price") * F.lit(1.5) * F.col("lat")).alias("adjusted"))


@q("f23_haversine", with_inputs("select order_key, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 3) as km from (select order_key, least(1, pow(sin(radians(lat - 45) / 2), 2) + cos(radians(45)) * cos(radians(lat)) * pow(sin(radians(lon - 7) / 2), 2)) as a from listings)"))
def f23(t: Tables):
    return t.listings().select("order_key", F.round(C.haversine_km(F.lit(45.0), F.lit(7.0), "lat", "lon"), 3).alias("km"))


@q("f24_round_one_place", with_inputs("select order_key, round(price, 1) as rounded from listings"))
def f24(t: Tables):
    return t.listings().select("order_key", F.round("price", 1).alias("rounded"))


@q("f25_month_start", with_inputs("select order_key, strftime(date_trunc('month', last_repost_date), '%Y-%m-%d') as month from listings"))
def f25(t: Tables):
    return t.listings().select("order_key", C.month_start("last_repost_date").cast("string").alias("month"))


@q("f26_calendar_parts", with_inputs("select order_key, year(last_repost_date) as year, month(last_repost_date) as month, strftime(last_repost_date, '%B') as month_name, strftime(last_repost_date, '%Y-%m') as year_month from listings"))
def f26(t: Tables):
    return t.listings().select("order_key", *[v.alias(k) for k, v in C.calendar_parts("last_repost_date").items()])


@q("f27_age_at_post", with_inputs("select order_key, coalesce(date_diff('day', make_date(cast(nullif(regexp_extract(ad_title || ' ' || description, '((?:19|20)\\d{2})', 1), '') as int), 1, 1), cast(original_post_date as date)), -1000) as age from listings"))
def f27(t: Tables):
    return t.listings().select("order_key", C.age_at_post("ad_title", "description", "original_post_date").alias("age"))


@q("f28_period_flag", "select event_id, case when ts + interval '1500 days' > timestamp '2020-03-20' and ts - interval '1000 days' < timestamp '2022-08-01' and ts - interval '1370 days' > timestamp '2020-03-20' and ts - interval '1370 days' < timestamp '2022-08-01' then 1 else 0 end as flag from events")
def f28(t: Tables):
    return t.events.select("event_id", C.covid_flag(F.expr("ts - interval '1370 days'")).alias("flag"))


@q("f29_days_between", "select event_id, cast(floor(epoch(timestamp '2024-01-20 06:00:00' - ts) / 86400) as int) as days from events")
def f29(t: Tables):
    return t.events.select("event_id", C.whole_days("ts", F.lit("2024-01-20 06:00:00").cast("timestamp_ntz")).alias("days"))


@q("f30_mixed_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def f30(t: Tables):
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MMM-dd-yyyy H:mm:ss")).when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select("o_orderkey", C.parse_post_date(text).cast("date").cast("string").alias("day"))


@q("f31_fixed_offset", "select event_id, round(epoch(ts + interval '7 hours' - timestamp '2024-01-01 00:00:00') / 3600, 6) as hours from events")
def f31(t: Tables):
    instant = C.fixed_offset_instant(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.round(C.hours_between(F.lit("2024-01-01 00:00:00").cast("timestamp"), instant), 6).alias("hours"))


@q("f32_shipping_label", with_inputs("select order_key, case when restrictions like '%Local pickup%' then 'local_pickup_only' when restrictions like '%within country%' then 'within_country' when restrictions like '%within continent%' then 'within_continent' when restrictions like '%globally%' then 'globally' when restrictions like '%ship locally%' then 'ship_locally' else 'None' end as label from listings"))
def f32(t: Tables):
    return t.listings().select("order_key", C.shipping_label("restrictions").alias("label"))


@q("f33_mentions_price", with_inputs("select order_key, regexp_matches(description, '[$][0-9]+[.]') as mentioned from listings"))
def f33(t: Tables):
    return t.listings().select("order_key", C.mentions_price("description").alias("mentioned"))


@q("f34_overpriced", with_inputs("select order_key, price - 6000 as overpriced_by, (price - 6000) / 6000 * 100 as overpriced_pct, case when price > 6000 then 'Overpriced' when price < 6000 then 'Underpriced' else 'Priced' end as kind from listings"))
def f34(t: Tables):
    parts = C.overpriced("price", F.lit(6000.0), F.coalesce("currency", F.lit("?")))
    rows = t.listings().select("order_key", *[v.alias(k) for k, v in parts.items()])
    return rows.select("order_key", "overpriced_by", "overpriced_pct", F.substring_index("price_text", " ", 1).alias("kind"))


@q("f35_listing_source", "select page_id, case when url like '%pinkbike%' then 'pinkbike' when url like '%buycycle%' then 'buycycle' else 'other' end as source from (select page_id, case when url like 'https%' then url || 'pinkbike' when url like '%.org%' then 'buycycle.' || url else url end as url from pages)")
def f35(t: Tables):
    url = F.expr("case when url like 'https%' then url || 'pinkbike' when url like '%.org%' then 'buycycle.' || url else url end")
    return t.pages.select("page_id", C.listing_source(url).alias("source"))


@q("f36_url_repair", "select page_id, case when url like 'https://%' then url else 'https://' || replace(url, 'http://', '') end as full_url, 'https://maker.example/a b' as target from pages")
def f36(t: Tables):
    bare = F.expr("case when url like 'https://%' then url else replace(url, 'http://', '') end")
    redirect = F.concat(F.lit("https://go.example/out?id="), F.col("page_id"), F.lit("&target=https%3A%2F%2Fmaker.example%2Fa%20b%3F99spokes%3D1"))
    return t.pages.select("page_id", C.with_scheme(bare).alias("full_url"), C.redirect_target(redirect).alias("target"))


@q("f37_unknown_to_null", "select doc_id, case when lang = 'en' then null else lang end as lang from documents")
def f37(t: Tables):
    return t.documents.select("doc_id", C.unknown_to_null(F.when(F.col("lang") == "en", "Unknown").otherwise(F.col("lang"))).alias("lang"))


@q("f38_flatten", "select o_orderkey, o_orderstatus || ',' || o_orderpriority || ',' || o_orderstatus as flat from orders")
def f38(t: Tables):
    nested = F.array(F.array("o_orderstatus", "o_orderpriority"), F.array("o_orderstatus"))
    return t.orders.select("o_orderkey", F.array_join(C.flatten(nested), ",").alias("flat"))


@q("f39_title_description", with_inputs("select order_key, ad_title || ' ' || description as text from listings"))
def f39(t: Tables):
    return t.listings().select("order_key", C.title_description("ad_title", "description").alias("text"))


@q("f40_residuals", with_inputs("select order_key, price - lat * 100 as resid, abs(price - lat * 100) as abs_resid, lat * 100 - lon as diff from listings"))
def f40(t: Tables):
    resid = F.col("price") - F.col("lat") * 100
    return t.listings().select("order_key", resid.alias("resid"), F.abs(resid).alias("abs_resid"), (F.col("lat") * 100 - F.col("lon")).alias("diff"))


@q("f41_file_stem", "select page_id, case when len(string_split(url, '/')) >= 2 then string_split(url, '/')[-2] end as stem from pages")
def f41(t: Tables):
    return t.pages.select("page_id", C.file_stem("url").alias("stem"))


@q("f42_markdown_and_html", with_inputs("select order_key, '| ' || ad_title || ' | ' || coalesce(currency, '') || ' |' as markdown, '<tr><td>' || ad_title || '</td><td>' || coalesce(currency, '') || '</td></tr>' as html from listings"))
def f42(t: Tables):
    return t.listings().select("order_key", C.markdown_row("ad_title", "currency").alias("markdown"), C.html_row("ad_title", "currency").alias("html"))


# --- UDF surface --------------------------------------------------------------


# A name whose last k of m letters give way to strange ones keeps m - k; the best window is cut behind them.
@q("u01_partial_ratio", """with named as (select p_partkey, length(p_name) as m, p_size % length(p_name) as k from part)
select p_partkey, 100.0::double as whole, 100.0::double as part_of, round(200.0::double * (m - k) / (2 * m - k), 6) as cut_off from named""")
def u01(t: Tables):
    title = F.concat(F.lit("2019 "), F.col("p_name"), F.lit(" for sale"))
    length = F.length("p_name")
    strange = F.concat(F.expr("left(p_name, length(p_name) - p_size % length(p_name))"), F.repeat(F.lit("#"), 2 * length))
    return t.part.select(
        "p_partkey", partial_ratio_udf("p_name", "p_name").alias("whole"), partial_ratio_udf("p_name", title).alias("part_of"),
        F.round(partial_ratio_udf("p_name", strange), 6).alias("cut_off"),
    )


@q("u08_ascii_fold", "select doc_id, md5(regexp_replace(strip_accents(replace(replace(lower(text), ' ', ''), '-', '')), '[^\\x00-\\x7F]', '', 'g')) as digest from documents")
def u08(t: Tables):
    return t.documents.select("doc_id", F.md5(ascii_fold("text")).alias("digest"))
