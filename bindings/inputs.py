"""Inputs derived from the driver's tables.

The derivations are plain expressions that Spark and the oracle both read, so
the oracle checks the operators and not the derivations. Every table below
covers all rows of its source and grows with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = {
    "order_key": "o_orderkey",
    "url": "'https://listings.example/ad/' || cast(o_orderkey as string) || '/'",
    "category": """c_mktsegment || case o_orderpriority when '1-URGENT' then ' Bikes' when '2-HIGH' then ' Bike Parts'
        when '3-MEDIUM' then ' E-Bikes' when '4-NOT SPECIFIED' then ' Enduro Bikes' else ' Frames' end""",
    "category_num": "c_nationkey",
    "region_code": "case when c_nationkey < 15 then 3 else 5 end",
    "ad_title": "cast(1980 + c_nationkey as string) || ' Norco ' || c_mktsegment || ' no ' || cast(o_orderkey as string)",
    "description": """case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then null
        when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'F' and c_acctbal < 0 then 'Was STOLEN and found, ' || c_name
        when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' and c_acctbal < 0 then 'Looking For a new rider, ' || c_name
        else 'Sold by ' || c_name || ' for $' || cast(cast(floor(o_totalprice) as bigint) as string) || '. Ride on' end""",
    "price": "o_totalprice / 20.7e0",
    "price_text": """case when o_orderstatus = 'P' then 'make offer' when o_orderstatus = 'O' then null
        else 'asking $' || cast(cast(floor(o_totalprice / 20.7e0) as bigint) as string) || '.50 firm' end""",
    "currency": """case when o_orderpriority = '5-LOW' and o_orderstatus = 'O' then null
        when o_orderpriority = '2-HIGH' and o_orderstatus = 'O' then 'zl'
        when o_orderstatus = 'F' then 'CAD' when o_orderstatus = 'O' then 'USD'
        when c_acctbal > 5000 then 'GBP' else 'EUR' end""",
    "location": """'City ' || cast(c_nationkey as string) || ', ' || case when c_nationkey < 6 then 'Canada'
        when c_nationkey < 12 then 'United States' when c_nationkey < 16 then 'United Kingdom'
        when c_nationkey < 22 then 'Germany' else 'Japan' end""",
    "frame_size": """case when c_nationkey < 5 then ' M ' when c_nationkey < 10 then '54cm' when c_nationkey < 15 then '17.5"'
        when c_nationkey < 20 then 'odd' end""",
    "front_travel": """case when c_nationkey < 8 then '150 mm' when c_nationkey < 12 then '0' when c_nationkey < 18 then '120.5mm'
        when c_nationkey < 20 then 'none' end""",
    "rear_travel": "case when c_nationkey < 10 then '140 mm' when c_nationkey < 14 then '.5' end",
    "material": "' ' || c_mktsegment || ' '",
    "restrictions": """case o_orderpriority when '1-URGENT' then 'No Trades, Local pickup only'
        when '2-HIGH' then 'Will ship within country' when '3-MEDIUM' then 'Will ship within continent, globally'
        when '4-NOT SPECIFIED' then 'Will ship locally or ship locally' end""",
    "still_for_sale": "case o_orderstatus when 'F' then 'Sold' when 'O' then 'Still For Sale' else 'marked SOLD' end",
    "view_count": "cast(o_custkey as string) || ' views'",
    "watch_count": "case when c_acctbal < 0 then null else cast(o_custkey as string) end",
    "original_post_date": "o_orderdate",
    "last_repost_date": """case when c_nationkey < 10 then o_orderdate + interval '20 days'
        else o_orderdate + interval '400 days' end""",
    "datetime_scraped": "o_orderdate + interval '30 days'",
    "lat": "-50 + c_nationkey * 4 + c_acctbal / 1000",
    "lon": "-160 + c_nationkey * 12 + c_acctbal / 500",
    "customer_key": "o_custkey",
}
LISTING_FROM = "orders join customer on o_custkey = c_custkey"

PLACES = {
    "location": LISTING["location"].replace("c_nationkey", "n_nationkey"),
    "lon": "-160 + n_nationkey * 12e0",
    "lat": "-50 + n_nationkey * 4e0",
}
PLACES_WHERE = "n_name not like '%4'"

# Two crawls of the same site: urgent orders are new, low ones are gone, some values differ.
CURRENT = {
    "price": "case when c_mktsegment = 'BUILDING' then o_totalprice / 25 else o_totalprice / 20.7e0 end",
    "description": f"case when c_mktsegment = 'MACHINERY' then '  edited ' || c_name when c_mktsegment = 'FURNITURE' then null else {LISTING['description']} end",
    "ad_title": f"case when c_mktsegment = 'HOUSEHOLD' then {LISTING['ad_title']} || '  ' else {LISTING['ad_title']} end",
    "currency": f"case when c_nationkey = 7 then 'CAD' else {LISTING['currency']} end",
    "datetime_scraped": "o_orderdate + interval '60 days'",
    "last_repost_date": "o_orderdate + interval '50 days'",
}
PREVIOUS_WHERE = "o_orderpriority <> '1-URGENT'"
CURRENT_WHERE = "o_orderpriority <> '5-LOW'"
# Already stored as sold.
SOLD_STORE_WHERE = "o_orderstatus = 'F' and c_acctbal > 4000"

# Index: mean order value per year and priority; some years are missing.
CPI = {"year": "year(o_orderdate)", "region": """case o_orderpriority when '1-URGENT' then 'united-states'
    when '2-HIGH' then 'canada' when '3-MEDIUM' then 'uk' when '4-NOT SPECIFIED' then 'eu' else 'elsewhere' end"""}
CPI_WHERE = "not (o_orderpriority = '2-HIGH' and year(o_orderdate) in (1997, 1998)) and year(o_orderdate) < 2001"

# Rates: order values as daily quotes per currency; some months are missing.
FX = {
    "currency": "case o_orderpriority when '1-URGENT' then 'USD' when '2-HIGH' then 'GBP' when '3-MEDIUM' then 'EUR' else 'zl' end",
    "ts": "o_orderdate",
    "rate": "o_totalprice / 100000",
}
FX_WHERE = "o_orderpriority <> '5-LOW' and month(o_orderdate) not in (4, 5) and year(o_orderdate) < 2001"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} as {name}" for name, expr in columns.items())


def _current() -> dict[str, str]:
    return {**LISTING, **CURRENT}


CTES = f"""with listings as (select {_select(LISTING)} from {LISTING_FROM}),
places as (select {_select(PLACES)} from nation where {PLACES_WHERE}),
previous as (select {_select(LISTING)} from {LISTING_FROM} where {PREVIOUS_WHERE}),
current_ads as (select {_select(_current())} from {LISTING_FROM} where {CURRENT_WHERE}),
sold_store as (select {_select(LISTING)} from {LISTING_FROM} where {SOLD_STORE_WHERE}),
cpi_raw as (select {_select(CPI)}, o_totalprice as value from orders where {CPI_WHERE}),
fx_raw as (select {_select(FX)} from orders where {FX_WHERE})
"""


class Tables:
    """The driver's tables and the inputs derived from them."""

    NAMES = (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    ).split()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _orders(self, columns: dict[str, str], where: str | None = None) -> DataFrame:
        joined = self.orders.join(self.customer, F.expr("o_custkey = c_custkey"))
        if where:
            joined = joined.where(where)
        return joined.select(*[F.expr(expr).alias(name) for name, expr in columns.items()])

    def listings(self) -> DataFrame:
        return self._orders(LISTING)

    def previous(self) -> DataFrame:
        return self._orders(LISTING, PREVIOUS_WHERE)

    def current(self) -> DataFrame:
        return self._orders(_current(), CURRENT_WHERE)

    def sold_store(self) -> DataFrame:
        return self._orders(LISTING, SOLD_STORE_WHERE)

    def places(self) -> DataFrame:
        return self.nation.where(PLACES_WHERE).select(*[F.expr(e).alias(n) for n, e in PLACES.items()])

    def cpi_raw(self) -> DataFrame:
        rows = self.orders.where(CPI_WHERE)
        return rows.select(*[F.expr(e).alias(n) for n, e in CPI.items()], F.col("o_totalprice").alias("value"))

    def fx(self) -> DataFrame:
        return self.orders.where(FX_WHERE).select(*[F.expr(e).alias(n) for n, e in FX.items()])


class Registry:
    """Queries by name with their oracle text."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(build: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: build(Tables(spark, folder))
            if sql is not None:
                self.oracles[name] = sql
            return build

        return register


def with_inputs(sql: str) -> str:
    """Oracle text over the derived inputs; text that starts with a comma adds its own."""
    return CTES + sql
