"""I and S groups: change capture, alerts, scans and sinks."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import columns as C
from marketloom.functions import fixed_values as fv
from marketloom.operators import changes as ch
from marketloom.operators import joins, windows
from marketloom.plans import alerts as al
from marketloom.plans.refresh import refresh
from marketloom.session import shared_folder
from marketloom.sources import indices, tables

from .inputs import Registry, Tables, with_inputs

q = Registry()

# --- change capture -----------------------------------------------------------


@q("i01_last_scrape", with_inputs("select c.category_num, cast(coalesce(p.a, timestamp '1900-01-01 00:00:00') as string) as last_scrape from (select distinct category_num from current_ads) c left join (select category_num, max(datetime_scraped) as a from previous where category <> 'BUILDING Frames' and region_code = 3 group by 1) p using (category_num)"))
def i01(t: Tables):
    stored = t.previous().where("category <> 'BUILDING Frames' and region_code = 3")
    wanted = t.current().select("category_num").distinct()
    return ch.with_anchor(wanted, ch.last_scrape(stored)).select("category_num", F.col("last_scrape").cast("string").alias("last_scrape"))


# The second crawl as listing pages: page and position follow the posting date, newest first.
LISTED = """, listed as (select *, case when o_status = 'x' then 'boosted' else 'not boosted' end as status from
(select *, case when region_code = 5 and watch_count is null then 'x' else '' end as o_status from current_ads)),
anchors as (select category_num, max(datetime_scraped) as last_scrape from previous group by 1),
aged as (select l.*, epoch(l.last_repost_date + interval '7 hours' - coalesce(a.last_scrape, timestamp '1900-01-01')) / 3600 > -48 or status = 'boosted' as fresh
  from listed l left join anchors a using (category_num))
"""


def listed(t: Tables):
    boosted = (F.col("region_code") == 5) & F.col("watch_count").isNull()
    return t.current().withColumn("status", F.when(boosted, "boosted").otherwise("not boosted"))


def _as_instants(df):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("datetime_scraped", "last_repost_date")})


@q("i02_recent_rows", with_inputs(LISTED + "select order_key, status from aged where fresh"))
def i02(t: Tables):
    rows = ch.with_anchor(_as_instants(listed(t)), ch.last_scrape(_as_instants(t.previous())))
    return ch.recent_rows(rows).select("order_key", "status")


@q("i03_prefix_cut", with_inputs(LISTED + ", cut as (select *, max(case when fresh then 0 else 1 end) over (partition by category_num order by original_post_date desc, order_key rows between unbounded preceding and current row) as stopped from aged) select order_key from cut where stopped = 0"))
def i03(t: Tables):
    rows = ch.with_anchor(_as_instants(listed(t)), ch.last_scrape(_as_instants(t.previous())))
    rows = rows.withColumn("page_no", -F.unix_micros(F.col("original_post_date").cast("timestamp")))
    return ch.recent_rows(rows, prefix=True, order=["page_no", "order_key"]).select("order_key")


@q("i04_routing", with_inputs("select c.order_key, case when lower(c.still_for_sale) not like '%sold%' then 'active' when s.url is null then 'sold' else 'known_sold' end as route from current_ads c left join sold_store s using (url)"))
def i04(t: Tables):
    return ch.route(t.current(), t.sold_store()).select("order_key", "route")


@q("i05_new_and_known", with_inputs("select c.order_key, p.url is null as is_new from current_ads c left join previous p using (url)"))
def i05(t: Tables):
    fresh = joins.new_rows(t.current(), t.previous()).select("order_key", F.lit(True).alias("is_new"))
    return fresh.unionByName(joins.known_rows(t.current(), t.previous()).select("order_key", F.lit(False).alias("is_new")))


CHANGED = " or ".join(f"p.{c} is distinct from c.{c}" for c in fv.WATCHED_COLUMNS)


@q("i06_changed_rows", with_inputs(f"select c.order_key from previous p join current_ads c using (url) where {CHANGED}"))
def i06(t: Tables):
    return ch.changed_rows(t.previous(), t.current()).select("order_key")


LOG = ", log_rows as (" + " union all ".join(
    f"select url, p.category, '{c}' as field, cast(p.{c} as string) as old_value, cast(c.{c} as string) as new_value, cast(cast(c.last_repost_date as date) as string) as update_date "
    f"from previous p join current_ads c using (url) where "
    + (f"p.{c} is distinct from c.{c}" if c == "price" else f"trim(p.{c}) is distinct from trim(c.{c})")
    for c in fv.WATCHED_COLUMNS
) + ")\n"


@q("i07_changelog", with_inputs(LOG + "select url, category, field, case when field = 'price' then null else old_value end as old_value, case when field = 'price' then null else new_value end as new_value, round(case when field = 'price' then cast(old_value as double) - cast(new_value as double) end, 6) as price_delta, update_date from log_rows"))
def i07(t: Tables):
    log = ch.changelog(t.previous(), t.current())
    is_price = F.col("field") == "price"
    delta = F.round(F.when(is_price, F.col("old_value").try_cast("double") - F.col("new_value").try_cast("double")), 6)
    text = {c: F.when(~is_price, F.col(c)) for c in ("old_value", "new_value")}
    return log.withColumn("price_delta", delta).withColumns(text)


@q("i07_membership", with_inputs("select url, 'previous' as side from previous where url not in (select url from current_ads) union all select url, 'updated' from current_ads where url not in (select url from previous)"))
def i07_membership(t: Tables):
    return ch.membership_differences(t.previous(), t.current())


@q("i08_insert_if_absent", with_inputs("select url, price from previous union all select url, price from current_ads where url not in (select url from previous)"))
def i08(t: Tables):
    stored, incoming = t.previous().select("url", "price"), t.current().select("url", "price")
    return ch.insert_if_absent(stored, incoming.unionByName(incoming), "url", ["price"])


@q("i09_keyed_update", with_inputs("select p.url, p.category, case when c.url is null then p.price else c.price end as price, case when c.url is null then p.description else c.description end as description from previous p left join current_ads c using (url)"))
def i09(t: Tables):
    stored = t.previous().select("url", "category", "price", "description")
    return ch.keyed_update(stored, t.current(), "url", ["price", "description"])


@q("i10_keyed_delete", with_inputs("select url from previous where url not in (select url from sold_store)"))
def i10(t: Tables):
    return ch.keyed_delete(t.previous().select("url"), t.sold_store())


# The fields of a category are those that its stored rows fill; a category without stored rows must fill all.
FIELDS = ", fields as (select category_num, bool_or(description is not null) as has_text, bool_or(currency is not null) as has_currency, bool_or(watch_count is not null) as has_watch from (select category_num, {text} as description, currency, watch_count from previous union all select category_num, {text}, currency, watch_count from sold_store) group by 1)"
LONG_TEXT = "case when category_num >= 5 then description end"


@q("i11_sold_capture", with_inputs(FIELDS.format(text=LONG_TEXT) + f"select url, price, cast(watch_count as double) as watch_count, cast(replace(view_count, ' views', '') as double) as view_count from current_ads c left join fields f using (category_num) where url not in (select url from sold_store) and lower(still_for_sale) like '%sold%' and (watch_count is not null or not coalesce(has_watch, true)) and ({LONG_TEXT} is not null or not coalesce(has_text, true))"))
def i11(t: Tables):
    """Categories below 5 have no description at all, so it is not asked of them."""
    columns = ["url", "price", "watch_count", "view_count", "still_for_sale", "datetime_scraped", "category_num", F.when(F.col("category_num") >= 5, F.col("description")).alias("description")]
    rows, stores = t.current().select(*columns), [t.previous().select(*columns), t.sold_store().select(*columns)]
    return ch.sold_capture(rows, t.sold_store(), fields=ch.category_fields(*stores)).select("url", "price", "watch_count", "view_count")


@q("i12_removal_set", with_inputs("select url from previous where url not in (select url from current_ads) or url in (select url from sold_store)"))
def i12(t: Tables):
    return ch.removal_set(t.previous(), t.current(), t.sold_store()).select("url")


# What a crawl returns: every current page, and the pages of vanished listings that are sold.
PAGES = """, crawl_listed as (select url, category_num, status, 1 as page_no, order_key as pos from listed),
parsed as (select url, category, category_num, ad_title, description, price, currency, still_for_sale, view_count, watch_count, last_repost_date, datetime_scraped from current_ads
  union all select url, category, category_num, ad_title, description, price, currency, 'Sold', view_count, watch_count, last_repost_date, datetime_scraped + interval '60 days' from previous where url not in (select url from current_ads) and region_code = 3),
fresh_ads as (select p.* from parsed p join aged a using (url) where a.fresh),
is_sold as (select *, lower(still_for_sale) like '%sold%' as sold_now, url in (select url from sold_store) as stored_sold from fresh_ads),
active_now as (select * exclude (sold_now, stored_sold) from is_sold where not sold_now
  union all select p.* from parsed p where p.url in (select url from crawl_listed) and p.url not in (select url from previous) and p.url not in (select url from fresh_ads) and lower(p.still_for_sale) not like '%sold%'),
sold_now as (select * exclude (sold_now, stored_sold) from is_sold where sold_now and not stored_sold
  union all select p.* from parsed p where p.url in (select url from previous) and p.url not in (select url from crawl_listed)),
new_sold as (select s.* from sold_now s left join fields f using (category_num) where url not in (select url from sold_store) and lower(still_for_sale) like '%sold%'
  and (description is not null or not coalesce(has_text, true)) and (currency is not null or not coalesce(has_currency, true)) and (watch_count is not null or not coalesce(has_watch, true)))
"""
STORE_COLUMNS = [
    "url", "category", "category_num", "ad_title", "description", "price", "currency", "still_for_sale", "view_count",
    "watch_count", "last_repost_date", "datetime_scraped",
]


CHANGES = ", changes as (" + " union all ".join(
    f"select url, '{c}' as field, cast(cast(c.last_repost_date as date) as string) as day, " + ("c.price" if c == "price" else "null::double") + " as price from active_now c join previous p using (url) where "
    + (f"p.{c} is distinct from c.{c}" if c == "price" else f"trim(p.{c}) is distinct from trim(c.{c})")
    for c in fv.WATCHED_COLUMNS
) + ")\n"


def _refresh(t: Tables):
    stored = _as_instants(t.previous()).select(*STORE_COLUMNS)
    sold = _as_instants(t.sold_store()).select(*STORE_COLUMNS)
    crawl = _as_instants(listed(t))
    pages = crawl.select("url", "category_num", "status", F.lit(1).alias("page_no"), F.col("order_key").alias("pos"))
    gone = t.previous().where("region_code = 3").join(t.current().select("url"), "url", "left_anti")
    gone = _as_instants(gone.withColumns({"still_for_sale": F.lit("Sold"), "datetime_scraped": F.expr("datetime_scraped + interval '60 days'")}))
    parsed = crawl.select(*STORE_COLUMNS).unionByName(gone.select(*STORE_COLUMNS))
    return refresh(stored, sold, pages, parsed)


@q("i13_refresh", with_inputs(LISTED + FIELDS.format(text="description") + PAGES + CHANGES + """select 'active' as part, url, price from (
  select p.url, case when c.url is null then p.price else c.price end as price from previous p left join (select c.* from active_now c join previous p on c.url = p.url where """ + CHANGED + """) c on p.url = c.url
  where p.url in (select url from crawl_listed) and p.url not in (select url from sold_store)
  union all select url, price from active_now where url not in (select url from previous))
union all select 'new active', url, price from active_now where url not in (select url from previous)
union all select 'new sold', url, price from new_sold
union all select 'sold', url, price from sold_store union all select 'sold', url, price from new_sold
union all select 'removed', url, price from previous where url not in (select url from crawl_listed) or url in (select url from sold_store)
union all select 'change of ' || field || ' on ' || coalesce(day, '?'), url, price from changes"""))
def i13(t: Tables):
    out = _refresh(t)
    named = F.concat(F.lit("change of "), "field", F.lit(" on "), F.coalesce("update_date", F.lit("?")))
    log = out.changes.select(named.alias("part"), "url", F.when(F.col("field") == "price", F.col("new_value").cast("double")).alias("price"))
    parts = {"active": out.active, "new active": out.new_active, "new sold": out.new_sold, "sold": out.sold, "removed": out.removed}
    tagged = [df.select(F.lit(name).alias("part"), "url", F.col("price").cast("double").alias("price")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged, log)


@q("i14_price_drops", with_inputs("select url, round(p.price - c.price, 6) as price_change from previous p join current_ads c using (url) where c.price < p.price and cast(c.last_repost_date as date) >= date '1997-01-01'"))
def i14(t: Tables):
    log = ch.changelog(t.previous(), t.current())
    drops = ch.price_drops(log, F.lit("1997-01-01 10:00:00").cast("timestamp"))
    return drops.select("url", F.round("price_change", 6).alias("price_change"))


RULES = [
    ("a1", 3, "ad_title like '%MACHINERY%'", "price < 20000 and pred_price_diff > -15000", "1996-05-01 00:00:00"),
    ("a2", -1, "category like '%Enduro%' and price < 9000", None, "1999-01-01 00:00:00"),
    ("a3", 4, "pricee < 3", None, "1999-01-01 00:00:00"),
    ("a4", -1, "reflect('java.lang.System', 'getProperty', 'user.name') = 'x'", None, "1996-05-01 00:00:00"),
    ("a5", -1, "cast(ad_title as int) > 1", None, "1996-05-01 00:00:00"),
    ("a6", 4, "reflect/**/('java.lang.System', 'getProperty', 'java.version') like '%'", None, "1996-05-01 00:00:00"),
    ("a7", -1, "r'\\' = ad_title or reflect('java.lang.System', 'getProperty', 'user.name') like '%' or ad_title = r'\\'", None, "1996-05-01 00:00:00"),
    ("a8", 3, "ad_title.str.contains('machinery', case=False) & category_num in [3, 4]", "0 < price < 20000 & pred_price_diff > -15000", "1996-05-01 00:00:00"),
]


def stored_rules(t: Tables) -> str:
    """Folder of the saved rules; one misspells a column, three try to call into the JVM, one fails on every row."""
    rows = [(u, "", c, text, price, at, "", "") for u, c, text, price, at in RULES]
    names = "uuid string, alert_name string, category_num int, search_string string, price_search_string string, last_checked string, email_stem string, email_domain string"
    rules = t.spark.createDataFrame(rows, names).withColumn("last_checked", F.col("last_checked").cast("timestamp"))
    folder = f"{shared_folder(t.spark, 'alerts')}/rules"
    tables.write_json_table(rules, folder)
    return folder


ALERTS = LOG + """, drops as (select url, cast(old_value as double) - cast(new_value as double) as price_change, cast(update_date as date) as d from log_rows
  where field = 'price' and cast(new_value as double) < cast(old_value as double)),
rules as (select * from (values ('a1', timestamp '1996-05-01'), ('a2', timestamp '1999-01-01'), ('a8', timestamp '1996-05-01')) r(alert_uuid, t)),
base as (select *, case currency when 'USD' then 1.25 when 'GBP' then 1.74 when 'EUR' then 1.49 when 'CAD' then 1.0 end::double * price as cad from current_ads),
hit as (select r.*, b.* from base b join rules r on datetime_scraped > t and
  case when alert_uuid in ('a1', 'a8') then category_num = 3 and ad_title like '%MACHINERY%' else category like '%Enduro%' and price < 9000 end),
full_hits as (select h.*, d.price_change, 5000.0::double - cad as diff from hit h left join drops d on d.url = h.url and d.d >= cast(h.t - interval '7 hours' as date)
  where case when alert_uuid in ('a1', 'a8') then cad < 20000 and 5000 - cad > -15000 else cad > 0 end)
"""


@q("i15_alerts", with_inputs(ALERTS + "select alert_uuid, url, coalesce(round(price_change, 4), 0) as price_change, round(diff, 4) as pred_price_diff, '' as error from full_hits union all select distinct alert_uuid, url, null::double, null::double, 'Unknown currency' from hit where cad is null and price is not null union all select 'a3', null, null, null, 'Check alert search string definition' union all select unnest(['a4', 'a6', 'a7']), null, null, null, 'Check alert search string definition'"))
def i15(t: Tables):
    base = _as_instants(t.current())
    rules = al.load_rules(tables.read_alerts(t.spark, stored_rules(t)))
    found = al.evaluate_alerts(base, ch.changelog(t.previous(), t.current()), rules, lambda df: df.withColumn("pred_price", F.lit(5000.0)))
    return found.select("alert_uuid", "url", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("price_change", "pred_price_diff")], "error")


@q("i16_stamp_alert", "select cast(user_id as string) as uuid, case when user_id = 5 then '2024-03-01 00:00:00' else cast(date_trunc('second', max(ts)) as string) end as last_checked from events group by user_id")
def i16(t: Tables):
    """Rules derived from events, written, read, stamped, written and read again."""
    rules = t.events.groupBy(F.col("user_id").cast("string").alias("uuid")).agg(F.date_trunc("second", F.max("ts")).cast("timestamp").alias("last_checked"))
    folder = shared_folder(t.spark, "alerts")
    tables.write_json_table(rules, f"{folder}/first")
    stamped = tables.stamp_alert(tables.read_alerts(t.spark, f"{folder}/first"), "5", F.lit("2024-03-01 00:00:00").cast("timestamp"))
    tables.write_json_table(stamped, f"{folder}/second")
    out = tables.read_alerts(t.spark, f"{folder}/second")
    return out.select("uuid", F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss").alias("last_checked"))


# --- scans and sinks ------------------------------------------------------------


def store_rows(t: Tables):
    """Listings in the stored layout."""
    dates = {c: F.col(c).cast("string") for c in ("original_post_date", "last_repost_date")}
    rows = _as_instants(t.listings()).withColumns({**dates, "condition": F.lit(None).cast("string"), "wheel_size": F.lit(None).cast("string"), "extra": F.lit(None).cast("map<string,string>")})
    from marketloom import schemas

    return rows.select(*t.spark.createDataFrame([], schemas.LISTING).columns)


@q("s01_dataset_scan", with_inputs("select url, category_num, region_code, price from listings where category_num = 7 and region_code = 3"))
def s01(t: Tables):
    folder = shared_folder(t.spark, "store")
    tables.write_dataset(store_rows(t), folder, "base")
    return tables.get_dataset(t.spark, folder, "base", 7, 3).select("url", "category_num", "region_code", "price")


@q("s02_parquet_scan", "select o_orderkey, o_totalprice from orders")
def s02(t: Tables):
    return tables.read_parquet(t.spark, f"{t.folder}/orders.parquet").select("o_orderkey", "o_totalprice")


@q("s03_parquet_version", with_inputs("select url, price from listings"))
def s03(t: Tables):
    path = tables.write_version(t.listings().select("url", "price"), shared_folder(t.spark, "history"), "2024-10-05_09_13_40")
    return tables.read_parquet(t.spark, path).select("url", "price")


@q("s04_csv_folder", "select p_partkey, p_name, p_retailprice from part")
def s04(t: Tables):
    folder = shared_folder(t.spark, "links")
    rows = t.part.select("p_partkey", "p_name", "p_retailprice")
    tables.write_csv(rows.repartition(4), folder)
    return tables.read_csv_folder(t.spark, folder, "p_partkey bigint, p_name string, p_retailprice double")


@q("s05_csv_sink", "select doc_id, text from documents")
def s05(t: Tables):
    folder = shared_folder(t.spark, "texts")
    tables.write_csv(t.documents.select("doc_id", "text"), folder)
    return t.spark.read.schema("doc_id bigint, text string").option("header", True).option("multiLine", True).option("escape", '"').csv(folder)


@q("s06_us_index", "with m as (select year(o_orderdate) as year, avg(o_totalprice) as cpi from orders where o_orderpriority = '1-URGENT' group by 1) select year, round(cpi, 4) as cpi, round((select max_by(cpi, year) from m), 4) as most_recent_cpi, 'USD' as currency from m")
def s06(t: Tables):
    folder = shared_folder(t.spark, "us-index")
    other = "case when o_orderpriority = '1-URGENT' then 'CUSR0000SA0      ' else ' CUSR0000SA1' end"
    columns = ["series_id", "year", "period", "cpi", "footnote"]
    year = F.year("o_orderdate")
    rows = t.orders.select(F.expr(other), year, F.lit("M01"), "o_totalprice", F.lit("")).toDF(*columns)
    rows.write.option("sep", "\t").option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(folder)
    return _rounded(indices.read_us(t.spark, folder))


def _rounded(df):
    return df.withColumns({c: F.round(c, 4) for c in ("cpi", "most_recent_cpi")})


YEARLY = "select year(o_orderdate) as year, round(avg(o_totalprice), 3) as cpi from orders where o_orderpriority = '{}' group by 1"


@q("s07_euro_index", f"with m as ({YEARLY.format('2-HIGH')}) select year, cpi, (select max_by(cpi, year) from m) as most_recent_cpi, 'EUR' as currency from m")
def s07(t: Tables):
    """One wide row per series, one column per year, gzip with tabs."""
    folder = shared_folder(t.spark, "euro-index")
    years = [str(y) for y in range(1995, 2002)]
    series = F.when(F.col("o_orderpriority") == "2-HIGH", indices.EU_SERIES).otherwise(F.concat(F.lit("A,"), "o_orderpriority"))
    dated = t.orders.withColumn("y", F.year("o_orderdate").cast("string"))
    wide = dated.groupBy(series.alias("key")).pivot("y", years).agg(F.round(F.avg("o_totalprice"), 3))
    wide.toDF(indices.EU_KEY_COLUMN, *[f"{y} " for y in years]).write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(folder)
    return indices.read_euro(t.spark, folder)


@q("s08_uk_index", f"with m as ({YEARLY.format('3-MEDIUM')}) select year, cpi, (select max_by(cpi, year) from m) as most_recent_cpi, 'GBP' as currency from m")
def s08(t: Tables):
    """Notes and quarterly rows around the yearly ones."""
    folder = shared_folder(t.spark, "uk-index")
    rows = t.orders.where("o_orderpriority = '3-MEDIUM'")
    value = F.round(F.avg("o_totalprice"), 3).cast("string")
    line = lambda period: F.concat(F.lit('"'), period, F.lit('","'), value, F.lit('"')).alias("value")
    year = F.year("o_orderdate").cast("string")
    yearly = rows.groupBy(year.alias("p")).agg(line(F.first(year))).select("value")
    quarter = F.concat(year, F.lit(" Q"), F.quarter("o_orderdate").cast("string"))
    quarterly = rows.groupBy(quarter.alias("p")).agg(line(F.first(quarter))).select("value")
    notes = t.region.select(F.concat(F.lit('"Important notes","'), "r_name", F.lit('"')).alias("value"))
    notes.unionByName(yearly).unionByName(quarterly).write.text(folder)
    return indices.read_uk(t.spark, folder)


@q("u07_canada_index", f"with m as ({YEARLY.format('4-NOT SPECIFIED')}) select year, cpi, (select max_by(cpi, year) from m) as most_recent_cpi, 'CAD' as currency, 'canada' as region from m")
def u07(t: Tables):
    folder = shared_folder(t.spark, "canada-index")
    product = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", indices.CANADA_PRODUCT).otherwise("Food, other")
    rows = t.orders.groupBy(F.year("o_orderdate").alias("REF_DATE"), product.alias("Products and product groups")).agg(F.round(F.avg("o_totalprice"), 3).alias("VALUE"))
    tables.write_csv(rows, folder)
    return indices.read_index(t.spark, "canada", folder)


@q("s09_json_scan", "select conv_id, turn, role, text from conversations")
def s09(t: Tables):
    """Files that hold one JSON array each, of some 500 rows."""
    folder = shared_folder(t.spark, "backfill")
    files = F.ceil(F.lit(t.conversations.count()) / 500)
    part = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.greatest(files, F.lit(1)))
    arrays = t.conversations.groupBy(part.alias("part")).agg(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("rows"))
    arrays.select(F.to_json("rows").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return tables.read_json_table(t.spark, folder, "conv_id bigint, turn bigint, role string, text string")


@q("s10_json_sink", "select conv_id, turn, role, text from conversations")
def s10(t: Tables):
    folder = shared_folder(t.spark, "json")
    tables.write_json_table(t.conversations, folder)
    return tables.read_json_lines(t.spark, folder, "conv_id bigint, turn bigint, role string, text string")


@q("s11_rows_as_json", "select conv_id, turn, role, text from conversations")
def s11(t: Tables):
    folder = shared_folder(t.spark, "rows")
    tables.write_rows_as_json(t.conversations, folder)
    text = tables.read_json_lines(t.spark, folder, "conv_id string, turn string, role string, text string")
    return text.withColumns({c: F.col(c).cast("bigint") for c in ("conv_id", "turn")})


@q("s12_table_sink", "select s_suppkey, s_acctbal, 'first' as tag from supplier union all select s_suppkey, s_acctbal, 'second' from supplier")
def s12(t: Tables):
    path = shared_folder(t.spark, "published")
    rows = t.supplier.select("s_suppkey", "s_acctbal")
    tables.write_table(rows.withColumn("tag", F.lit("stale")), path)
    tables.write_table(rows.withColumn("tag", F.lit("first")), path, "replace")
    tables.write_table(rows.withColumn("tag", F.lit("second")), path, "append")
    return tables.read_parquet(t.spark, path)


@q("s13_bound_parameters", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice < 50000")
def s13(t: Tables):
    text = "select o_orderkey, o_totalprice from {orders} where o_orderstatus = :status and o_totalprice < :limit"
    return tables.query(t.spark, text, {"status": "F", "limit": 50000}, orders=t.orders)


@q("s14_daily_table", with_inputs("select url, price, cast(replace(view_count, ' views', '') as double) as view_count, coalesce(cast(watch_count as double), 0) as watch_count from listings"))
def s14(t: Tables):
    folder = shared_folder(t.spark, "daily")
    build = lambda: t.listings().select("url", "price", "view_count", "watch_count")
    tables.daily_listing_table(t.spark, folder, "20240101", build)
    return tables.daily_listing_table(t.spark, folder, "20240101", build).select("url", "price", "view_count", "watch_count")


@q("s15_page_scan", "select page_id, url, length(html) as n_chars from pages")
def s15(t: Tables):
    return tables.read_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@q("s16_column_names", "select n_nationkey as nation_key, n_name as nation_name from nation")
def s16(t: Tables):
    return C.normalize_names(t.nation.select(F.col("n_nationkey").alias("Nation Key:"), F.col("n_name").alias("Nation Name:")))


@q("s17_historical_sold", with_inputs("select url, 'Local' as restrictions, strftime(original_post_date, '%Y-%m-%d') as day from listings where still_for_sale like '%Sold%'"))
def s17(t: Tables):
    from marketloom.plans.price_history import historical_sold

    raw = t.listings().select("url", F.concat(F.lit(" "), "still_for_sale").alias("Still For Sale:"), F.date_format("original_post_date", "MMM-dd-yyyy H:mm:ss").alias("Original Post Date:"))
    limits = t.listings().select("url", F.lit(" Local ").alias("Restrictions:"))
    out = historical_sold(raw, limits, ["original_post_date"])
    return out.select("url", "restrictions", F.col("original_post_date").cast("date").cast("string").alias("day"))


@q("w01_latest_listing", "select user_id, max(ts)::string as ts from events group by 1")
def w01_listing(t: Tables):
    return windows.latest_row(t.events, "user_id", "ts", ["event_id"]).select("user_id", F.col("ts").cast("string").alias("ts"))
