"""One refresh of the listing store, all categories at once.

Store, sold listings, listing pages and parsed pages meet by url in one tagged union: every input is read once and dealt by
url once. The merged rows are written once; what becomes of a row is then an expression of that row, and each
output is a filter over the written table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..operators import changes as ch
from ..operators.windows import take_while
from ..session import materialize, sized_broadcast

INPUTS = ["stored", "sold", "page", "listing"]


@dataclass
class Refresh:
    """Next versions and the log of one refresh; every part is a lazy DataFrame over the merged table."""

    active: DataFrame
    sold: DataFrame
    changes: DataFrame
    new_active: DataFrame
    new_sold: DataFrame
    removed: DataFrame


def merged(active: DataFrame, sold: DataFrame, listed: DataFrame, parsed: DataFrame) -> DataFrame:
    """All stored and sold rows, and one row for each other url, each with what the inputs say of its url.

    Columns: url; `stored` and `sold`, the row itself where it is one; `head`, true for one row per url; `before`, the latest stored row;
    `page`, the page scraped last; `listing`, the last place in the listing; `was_sold`.
    """
    inputs = dict(zip(INPUTS, [active, sold, parsed, listed.select("url", F.struct("page_no", "pos", "status").alias("_place"))]))
    own = {name: F.col("_place") if name == "listing" else F.struct(*[F.col(c) for c in df.columns]) for name, df in inputs.items()}
    kinds = {name: df.select(own[name].alias("x")).schema["x"].dataType for name, df in inputs.items()}
    tagged = [
        df.select("url", F.lit(i).alias("tag"), *[(own[n] if n == name else F.lit(None)).cast(kinds[n]).alias(n) for n in INPUTS])
        for i, (name, df) in enumerate(inputs.items())
    ]
    rows = reduce(DataFrame.union, tagged)
    same = Window.partitionBy("url")
    latest = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.datetime_scraped"), F.xxhash64(name)))).over(same)
    rows = rows.select(
        "url", "tag", "stored", "sold",
        (F.row_number().over(same.orderBy("tag")) == 1).alias("head"),
        latest("stored").alias("before"),
        latest("page").alias("page"),
        F.max("listing").over(same).alias("listing"),
        F.max(F.col("sold").isNotNull()).over(same).alias("was_sold"),
    )
    return rows.where("head or tag < 2").drop("tag")


def refresh(
    active: DataFrame,
    sold: DataFrame,
    listed: DataFrame,
    parsed: DataFrame,
    full_refresh: bool = False,
    prefix: bool = False,
    strict: bool = True,
    numbers: list[str] = ("price", "watch_count", "view_count"),
) -> Refresh:
    """Apply one crawl to the store.

    `listed`: url, category_num, status, page_no, pos of every listing page.
    `parsed`: one row per page that could be read, with the listing columns;
    it covers listed urls and, where their page still exists, vanished ones. Of several pages of one url the one scraped last counts.
    Which fields a sold row must fill follows from what the store and the sold listings hold of its category, not from the crawl.
    """
    rows = materialize(merged(active, sold, listed, parsed), "merged")
    by_category = rows.groupBy(F.coalesce("stored.category_num", "sold.category_num").alias("of"))
    filled = lambda c: reduce(lambda a, b: a | b, [F.col(f"{n}.{c}").isNotNull() for n, df in (("stored", active), ("sold", sold)) if c in df.columns], F.lit(False))
    known = by_category.agg(F.max("stored.datetime_scraped").alias("anchor"), *[F.max(filled(c)).alias(f"_{c}") for c in parsed.columns])
    fields = F.array_compact(F.array(*[F.when(F.col(f"_{c}"), F.lit(c)) for c in parsed.columns]))
    categories = materialize(known.select("of", "anchor", fields.alias("fields")).where("of is not null"), "categories")

    floor = F.lit(ch.EPOCH).cast(active.schema["datetime_scraped"].dataType)
    anchor = floor if full_refresh else F.coalesce("anchor", floor)
    rows = rows.join(sized_broadcast(categories), F.col("page.category_num") == F.col("of"), "left").withColumn("last_scrape", anchor)

    is_ad = F.col("page").isNotNull() & F.col("listing").isNotNull()
    recent = is_ad & ch.is_recent("page.last_repost_date", "listing.status")
    if prefix:
        ads = rows.where(F.col("head") & is_ad).select("url", "page.category_num", "listing.page_no", "listing.pos", recent.alias("recent"))
        cut = materialize(take_while(ads, ["category_num"], ["page_no", "pos"], ~F.col("recent")).select("url", F.lit(True).alias("in_prefix")), "prefix")
        rows = rows.join(cut, "url", "left")
        recent = F.coalesce("in_prefix", F.lit(False))
    page_sold, was_stored = ch.looks_sold("page.still_for_sale"), F.col("before").isNotNull()
    # A listed page that is neither stored nor recent was missed by earlier refreshes.
    missed = is_ad & ~recent & ~was_stored & ~page_sold
    live = recent & (~page_sold | (F.lit(not strict) & F.col("was_sold")))
    current = live | missed
    differs = reduce(lambda a, b: a | b, [~F.col(f"before.{c}").eqNullSafe(F.col(f"page.{c}")) for c in fv.WATCHED_COLUMNS])
    vanished = was_stored & F.col("listing").isNull()
    sold_page = (recent | (vanished & F.col("page").isNotNull())) & page_sold & ~F.col("was_sold")
    flags = {
        "changed": current & was_stored & differs,
        "fresh": F.col("head") & current & ~was_stored,
        "captured": F.col("head") & sold_page & ch.is_complete(parsed.columns, F.col("fields"), lambda c: F.col(f"page.{c}")),
        "gone": was_stored & (F.col("listing").isNull() | F.col("was_sold")),
    }
    rows = rows.withColumns({name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()})

    new_active = rows.where("fresh").select("page.*")
    new_sold = C.convert_to_float(rows.where("captured").select("page.*"), list(numbers))
    replaced = [*fv.WATCHED_COLUMNS, "datetime_scraped", "last_repost_date"]
    kinds = {c: active.schema[c].dataType for c in fv.WATCHED_COLUMNS}
    entries = ch.change_entries(F.col("before"), F.col("page"), kinds)
    log = rows.where("head and changed").select("url", F.col("before.category").alias("category"), F.inline(entries), C.page_time("page.last_repost_date").cast("date").cast("string").alias("update_date"))
    kept = rows.where("stored is not null and not gone").select([_next(c, c in replaced) for c in active.columns])
    return Refresh(
        active=kept.unionByName(ch.typed_as(new_active, kept), allowMissingColumns=True),
        sold=(held := rows.where("sold is not null").select("sold.*")).unionByName(ch.typed_as(new_sold, held), allowMissingColumns=True),
        changes=log,
        new_active=new_active,
        new_sold=new_sold,
        removed=rows.where("stored is not null and gone").select("stored.*"),
    )


def _next(column: str, replaced: bool) -> Column:
    own = F.col(f"stored.{column}")
    return (F.when(F.col("changed"), F.col(f"page.{column}")).otherwise(own) if replaced else own).alias(column)
