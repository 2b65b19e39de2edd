"""X group: page extraction.

Where the driver's pages lack a layout, pages are rendered from its tables (one
page per row), so the expected fields are known to the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import pages as P

from .inputs import Registry, Tables, with_inputs

q = Registry()

NOW = "2024-08-16 10:34:21"


def stamp():
    return F.lit(NOW).cast("timestamp")


@q("x01_link_scan", r"""with a as (select page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') as l from pages),
u as (select page_id, unnest(l) as a, generate_subscripts(l, 1) - 1 as pos from a)
select page_id, pos::int as pos, regexp_extract(a, '(?is)href="([^"]*)"', 1) as href, regexp_replace(a, '(?s)<[^>]*>', '', 'g') as text from u""")
def x01(t: Tables):
    return P.links(t.pages)


def rendered(df, key: str, html: str):
    return df.select(F.col(key).alias("page_id"), F.expr(html).alias("html"))


CATEGORY_PAGE = """'<html><body><a href="/list/?region=3&category=' || cast(c_nationkey as string) || '">' || c_mktsegment ||
'</a> <a name="top">none</a><a class="x" href="/list/?page=9">next</a></body></html>'"""


@q("x02_category_numbers", "select c_mktsegment as category, max_by(c_nationkey, c_custkey)::bigint as category_num from customer group by 1")
def x02(t: Tables):
    return P.category_numbers(P.links(rendered(t.customer, "c_custkey", CATEGORY_PAGE)))


RESULT_PAGE = """'<div><a href="https://www.pinkbike.com/buysell/' || cast(1000000 + o_orderkey as string) || '/">A</a>
<a href="https://www.pinkbike.com/buysell/' || cast(1000000 + o_orderkey as string) || '/">again</a><a href="/help">help</a>
<a href="https://www.pinkbike.com/buysell/' || cast(2000000 + o_custkey as string) || '/">B</a>
<a href="https://www.pinkbike.com/buysell/' || cast(3000000 + o_custkey as string) || '/">C</a></div>
<div class="bsitem' || case when o_orderpriority = '1-URGENT' then ' boosted' else '' end || '">A</div><div class="bsitems">no</div>
<div id="z" class="bsitem">B</div>' || case when o_orderstatus = 'F' then '<div class="bsitem boosted">C</div><div class="bsitem">D</div>' else '' end"""


@q("x03_listing_results", """select o_orderkey as page_id, 0 as pos, 'https://www.pinkbike.com/buysell/' || cast(1000000 + o_orderkey as string) || '/' as url, case when o_orderpriority = '1-URGENT' then 'boosted' else 'not boosted' end as status from orders
union all select o_orderkey, 1, 'https://www.pinkbike.com/buysell/' || cast(2000000 + o_custkey as string) || '/', 'not boosted' from orders
union all select o_orderkey, 2, 'https://www.pinkbike.com/buysell/' || cast(3000000 + o_custkey as string) || '/', 'boosted' from orders where o_orderstatus = 'F'""")
def x03(t: Tables):
    return P.listing_results(rendered(t.orders, "o_orderkey", RESULT_PAGE))


LAST_PAGE = """case when o_orderstatus = 'P' then '<a href="/x">1</a>' else '<a href="/list/?page=2&c=1">2</a><a href="/list/?c=1&page=' || cast(o_custkey as string) || '">last</a>' end"""


@q("x04_last_page", "select o_orderkey as page_id, case when o_orderstatus = 'P' then 0 else greatest(2, o_custkey) end as last_page from orders")
def x04(t: Tables):
    return P.last_page(rendered(t.orders, "o_orderkey", LAST_PAGE))


LAYOUT_A = """'<html><body><h1 class="buysell-title">' || ad_title || '</h1><div class="buysell-container details"><b>Category:</b> ' || category ||
'<br><b>Front Travel:</b>  150   mm<br><b>Still For Sale:</b>\n<span style="x">' || still_for_sale || ' </span><br><b>View Count:</b> ' || view_count ||
'<br><b>Paint Code:</b> red</div><div class="buysell-container buysell-price">$' || cast(cast(floor(price / 1000) as bigint) as string) || ',500 ' || coalesce(currency, 'CAD') ||
' </div><div class="buysell-container description">' || coalesce(description, 'none') || '\n\t two  lines</div><span class="f11">\nMember since\n  ' || location ||
'\n</span><div class="buysell-container"><b>Restrictions:</b> ' || coalesce(restrictions, 'nil') || '</div></body>'"""

EXPECTED_A = """ad_title, trim(category) as category, '150 mm' as front_travel, still_for_sale, view_count, cast(floor(price / 1000) as bigint) * 1000.0::double + 500 as price,
coalesce(currency, 'CAD') as currency, coalesce(description, 'none') || ' two lines' as description, location, coalesce(restrictions, 'nil') as restrictions"""
FIELDS_A = ["ad_title", "category", "front_travel", "still_for_sale", "view_count", "price", "currency", "description", "location", "restrictions"]


@q("x05_layout_a", with_inputs(f"select url, {EXPECTED_A}, 'red' as paint_code from listings"))
def x05(t: Tables):
    pages = t.listings().select("url", F.expr(LAYOUT_A).alias("html"))
    return P.parse_layout_a(pages).select("url", *FIELDS_A, F.col("extra")["paint_code"].alias("paint_code"))


LAYOUT_B = """'<div class="modal-header"><p class="content-secondary"> Norco </p><h2 class="content-primary">' || category || '</h2></div>
<div class="px-3 py-4 bike-info-header"><div>' || ad_title || '\n  </div></div><p class="text-2xl font-500 mb-0 content-primary">' ||
case when currency = 'EUR' then cast(cast(floor(price) as bigint) as string) || ' €' when currency = 'GBP' then '£' || cast(cast(floor(price) as bigint) as string) else 'ask' end ||
'</p><p class="text-sm content-tertiary wrap-1 mb-0"> ' || location || '</p><div class="general-information"><div class="d-flex align-items-center flex-nowrap">
<span class="content-tertiary">Year:</span><span class="content-primary">2022</span></div><div class="d-flex align-items-center flex-nowrap"><span class="content-tertiary">Size</span>
<span class="content-primary"> - </span></div></div><div class="seller-info"><div class="info-text"> ' || still_for_sale || ' now</div></div>
<div class="parts parts-modal"><h3>Original Parts</h3><div class="d-flex align-items-center"><span class="content-tertiary">Fork:</span><span class="content-primary">Carbon</span></div></div>'"""


@q("x06_layout_b", with_inputs("""select url, ad_title, case when currency in ('EUR', 'GBP') then cast(cast(floor(price) as bigint) as string) end as price,
case when currency in ('EUR', 'GBP') then currency end as currency, location,
concat_ws(chr(10) || chr(10), 'Brand: Norco', 'Model: ' || category, 'General Information:', 'Year: 2022', 'Seller Description:', still_for_sale || ' now', chr(10) || 'Original Parts:', 'Fork: Carbon') as description from listings"""))
def x06(t: Tables):
    return P.parse_layout_b(t.listings().select("url", F.expr(LAYOUT_B).alias("html")))


def mixed_pages(t: Tables):
    site = "case when region_code = 3 and currency = 'CAD' then 'https://www.pinkbike.com/' when currency in ('EUR', 'GBP') then 'https://buycycle.com/' else 'https://other.example/' end"
    rows = t.listings().withColumn("url", F.concat(F.expr(site), F.col("order_key").cast("string")))
    html = F.when(F.col("url").contains("pinkbike"), F.expr(LAYOUT_A)).otherwise(F.expr(LAYOUT_B))
    return rows.select("url", html.alias("html"))


MIXED = """, mixed as (select *, case when region_code = 3 and currency = 'CAD' then 'https://www.pinkbike.com/' when currency in ('EUR', 'GBP') then 'https://buycycle.com/' else 'https://other.example/' end || cast(order_key as string) as page_url from listings)
"""


@q("x07_dispatch", with_inputs(MIXED + """select page_url as url, 'parsed' as mode, ad_title, case when page_url like '%pinkbike%' then cast(floor(price / 1000) as bigint) * 1000.0::double + 500 else cast(floor(price) as bigint)::double end as price, 3 as region_code from mixed where page_url not like '%other%'
union all select page_url, 'other', null, null, null from mixed where page_url like '%other%'"""))
def x07(t: Tables):
    parsed, rejected = P.parse_listings(mixed_pages(t), stamp())
    good = parsed.select("url", F.lit("parsed").alias("mode"), "ad_title", "price", "region_code")
    return good.unionByName(rejected, allowMissingColumns=True)


@q("x08_normalize", with_inputs(MIXED + "select page_url as url, nullif(regexp_extract(ad_title, '((?:19|20)\\d{2})', 1), '') as model_year, nullif(regexp_extract(location, '(Canada|United States|United Kingdom)', 1), '') as country from mixed where page_url not like '%other%'"))
def x08(t: Tables):
    parsed, _ = P.parse_listings(mixed_pages(t), stamp())
    return P.normalize_parsed(parsed, stamp()).select("url", "model_year", "country")


SPEC_PAGE = """'<div><table><tr><th>Price Range</th><td>$' || cast(p_size as string) || '</td></tr><tr><td>Frame-set</td><td> ' || p_type || ' </td></tr></table>
<table><tr><td>Build</td><td>' || p_brand || '</td></tr><tr><td>lonely</td></tr></table></div>'"""


@q("x09_spec_tables", """select p_partkey as page_id, 0 as table_no, 'price_range' as label, '$' || cast(p_size as string) as value from part
union all select p_partkey, 0, 'frame_set', p_type from part union all select p_partkey, 1, 'build', p_brand from part""")
def x09(t: Tables):
    return P.spec_table_rows(rendered(t.part, "p_partkey", SPEC_PAGE), ["page_id"])


@q("x09_spec_rows_wide", "select p_partkey as page_id, '$' || cast(p_size as string) as price_range_summary, p_type as frame_set_summary, p_brand as build from part")
def x09_wide(t: Tables):
    from marketloom.operators.reshape import label_values_to_row, suffix_labels

    long = suffix_labels(P.spec_table_rows(rendered(t.part, "p_partkey", SPEC_PAGE), ["page_id"]))
    return label_values_to_row(long, "page_id", ["price_range_summary", "frame_set_summary", "build"])


IMAGE_PAGE = """case when p_size < 25 then '<img data-fullimageurl="/no.jpg"><div class="selectable" id="buysell-image" data-fullimageurl="/img/' || cast(p_partkey as string) || '.jpg">' else '<div id="other">' end"""


@q("x10_first_image", "select p_partkey as page_id, case when p_size < 25 then '/img/' || cast(p_partkey as string) || '.jpg' end as image_url from part")
def x10(t: Tables):
    return rendered(t.part, "p_partkey", IMAGE_PAGE).select("page_id", P.first_image().alias("image_url"))


@q("x11_blocked_pages", "select page_id, url like '%spam%' or url like '%.net%' as blocked from pages")
def x11(t: Tables):
    text = F.expr("html || case when url like '%spam%' then ' Sorry, You Have Been BLOCKED' when url like '%.net%' then '/cdn-cgi/challenge-platform/h/b/orchestrate/' else '' end")
    good, bad = P.split_blocked(t.pages.select("page_id", text.alias("html")))
    return good.select("page_id", F.lit(False).alias("blocked")).unionByName(bad.select("page_id", F.lit(True).alias("blocked")))


MODEL_PAGE = """'<a href="/en/bikes/' || cast(p_partkey as string) || '"><b>' || cast(2000 + p_size as string) || '</b> ' || p_brand || ' ' || p_name || '</a><a href="/en/help">2020 reasons</a>'"""


@q("x12_model_links", "select p.p_partkey as page_id, 'https://specs.example/en/bikes/' || cast(p.p_partkey as string) as model_url, m.maker as manufacturer, cast(2000 + p_size as string) as year from part p join (select distinct p_brand as maker from part where p_size < 30) m on starts_with(p.p_brand || ' ' || p.p_name, m.maker)")
def x12(t: Tables):
    makers = t.part.where("p_size < 30").select(F.col("p_brand").alias("manufacturer")).distinct()
    found = P.model_links(P.links(rendered(t.part, "p_partkey", MODEL_PAGE)), makers, "https://specs.example")
    return found.select("page_id", "model_url", "manufacturer", "year")


@q("x12_empty_families", "select p_partkey as page_id, 'family/' || p_name as url, 'no models found for family' as error from part where p_size >= 25")
def x12_families(t: Tables):
    families = t.part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("family/"), "p_name").alias("url"), "p_size")
    found = families.where("p_size < 25").select("page_id")
    return P.families_without_models(families, found)
