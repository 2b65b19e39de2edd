"""Change capture over listing tables: what is new, changed, sold or gone.

Stored tables are immutable versions: each operator returns the next version as
a DataFrame and the caller writes it to a new place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..session import sized_broadcast
from .joins import known_rows, new_rows, vanished_rows
from .windows import latest_row, take_while, top_n

EPOCH = "1900-01-01 00:00:00"


def last_scrape(stored: DataFrame, keys: list[str] = ("category_num",), ts: str = "datetime_scraped") -> DataFrame:
    return stored.groupBy(*keys).agg(F.max(ts).alias("last_scrape"))


def with_anchor(df: DataFrame, anchors: DataFrame, keys: list[str] = ("category_num",), full_refresh: bool = False) -> DataFrame:
    """Attach the last scrape of the row's category; 1900 when there is none or on a full refresh."""
    floor = F.lit(EPOCH).cast(anchors.schema["last_scrape"].dataType)
    if full_refresh:
        return df.withColumn("last_scrape", floor)
    return df.join(anchors, list(keys), "left").withColumn("last_scrape", F.coalesce("last_scrape", floor))


def is_recent(repost: str = "last_repost_date", status: str = "status", hours: int = fv.RECENT_HOURS) -> Column:
    """Reposted no more than `hours` before the last scrape (repost time stands in UTC-7), or boosted."""
    age = C.hours_between("last_scrape", C.fixed_offset_instant(C.page_time(repost)))
    return F.coalesce(age > -hours, F.lit(False)) | F.coalesce(F.col(status) == "boosted", F.lit(False))


def recent_rows(df: DataFrame, prefix: bool = False, category: str = "category_num", order: list[str] = ("page_no", "pos")) -> DataFrame:
    """Recent rows as a plain filter, or the listing prefix before the first old row."""
    return take_while(df, [category], list(order), ~is_recent()) if prefix else df.where(is_recent())


def looks_sold(status: str = "still_for_sale") -> Column:
    return F.coalesce(F.lower(status).contains("sold"), F.lit(False))


def route(ads: DataFrame, sold_store: DataFrame, key: str = "url", strict: bool = True) -> DataFrame:
    """Tag each ad `sold` (and not stored as sold yet), `known_sold` or `active`.

    With strict=False an ad that is sold and already stored counts as active.
    """
    stored = sold_store.select(key).distinct().withColumn("_stored", F.lit(True))
    joined = ads.join(stored, key, "left")
    repeated = F.lit("known_sold" if strict else "active")
    tag = F.when(looks_sold() & F.col("_stored").isNull(), "sold").when(looks_sold(), repeated).otherwise("active")
    return joined.withColumn("route", tag).drop("_stored")


def changed_flag(old: DataFrame, new: DataFrame, columns: list[str]) -> Column:
    """Any watched column differs; null against null is no change."""
    return reduce(lambda a, b: a | b, [~old[c].eqNullSafe(new[c]) for c in columns])


def changed_rows(previous: DataFrame, updated: DataFrame, key: str = "url", columns: list[str] | None = None) -> DataFrame:
    """Updated rows that differ from the stored version in a watched column."""
    watched = columns or fv.WATCHED_COLUMNS
    return updated.join(previous, (updated[key] == previous[key]) & changed_flag(previous, updated, watched), "left_semi")


def changelog(
    previous: DataFrame,
    updated: DataFrame,
    columns: list[str] | None = None,
    key: str = "url",
    category: str = "category",
    repost: str = "last_repost_date",
) -> DataFrame:
    """One row per changed field with old and new value as text.

    Text is compared trimmed, so an edit of outer whitespace logs nothing.
    """
    watched = columns or fv.WATCHED_COLUMNS
    old = previous.select(key, category, F.struct(*watched).alias("_old"))
    new = updated.select(key, C.page_time(repost).cast("date").cast("string").alias("update_date"), F.struct(*watched).alias("_new"))
    kinds = {c: previous.schema[c].dataType for c in watched}
    joined = old.join(new, key).withColumn("_changes", change_entries(F.col("_old"), F.col("_new"), kinds))
    return joined.select(key, category, F.inline("_changes"), "update_date")


def change_entries(old: Column, new: Column, kinds: dict[str, T.DataType]) -> Column:
    """Array of (field, old_value, new_value) for the fields in which two structs differ; text is compared trimmed."""
    entries = []
    for c, kind in kinds.items():
        before, after = old[c], new[c]
        differs = ~F.trim(before).eqNullSafe(F.trim(after)) if isinstance(kind, T.StringType) else ~before.eqNullSafe(after.cast(kind))
        entry = F.struct(F.lit(c).alias("field"), before.cast("string").alias("old_value"), after.cast("string").alias("new_value"))
        entries.append(F.when(differs, entry))
    return F.array_compact(F.array(*entries))


def membership_differences(previous: DataFrame, updated: DataFrame, key: str = "url") -> DataFrame:
    """Keys that only one side has; a change log needs this to be empty."""
    left = new_rows(previous.select(key), updated, key).withColumn("side", F.lit("previous"))
    right = new_rows(updated.select(key), previous, key).withColumn("side", F.lit("updated"))
    return left.unionByName(right)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str = "url", order: list[str] = ()) -> DataFrame:
    """Next version with incoming rows whose key is new; of repeated keys one row goes in.

    It is the first by `order`; without one, and among ties, the row whose columns come first as text. Incoming values take the stored types.
    """
    fresh = new_rows(typed_as(incoming, stored), stored, key)
    single = top_n(fresh, [key], [*[F.asc(c) for c in order], *_by_text(fresh)])
    return stored.unionByName(single, allowMissingColumns=True)


def typed_as(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows with the types of the stored columns; values that do not convert become null."""
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    typed = {c: F.col(c).try_cast(kinds[c]) for c in incoming.columns if c in kinds and kinds[c] != incoming.schema[c].dataType}
    return incoming.withColumns(typed) if typed else incoming


def _by_text(df: DataFrame) -> list[Column]:
    """An order of rows that only equal rows share; maps have none and are left out."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [F.to_json(F.struct(*plain)).asc()]


def keyed_update(stored: DataFrame, updates: DataFrame, key: str, columns: list[str], order: list[str] = ()) -> DataFrame:
    """Next version with `columns` replaced where the key matches; unmatched updates do nothing.

    Of updates with one key the last by `order` counts; without one, and among ties, the row whose columns come first as text.
    """
    missing = {key, *columns} - set(updates.columns)
    if missing:
        raise ValueError(f"missing in updates: {sorted(missing)}")
    single = top_n(updates, [key], [*[F.desc_nulls_last(c) for c in order], *_by_text(updates)])
    patch = single.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = stored.join(patch, key, "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select([new.get(c, F.col(c)).alias(c) for c in stored.columns])


def keyed_delete(stored: DataFrame, removals: DataFrame, key: str = "url") -> DataFrame:
    if key not in removals.columns:
        raise ValueError(f"{key} must be a column of the removals")
    return new_rows(stored, removals, key)


def category_fields(*stores: DataFrame, category: str = "category_num") -> DataFrame:
    """(category, fields): the columns that any stored row of the category fills. Categories differ in the fields of their pages."""
    rows = [df.select(F.col(category).alias("category"), _filled(df.columns, F.col).alias("fields")) for df in stores]
    filled = reduce(DataFrame.unionByName, rows).select("category", F.explode_outer("fields").alias("field")).distinct()
    return filled.groupBy("category").agg(F.collect_set("field").alias("fields"))


def _filled(columns: list[str], value: Callable[[str], Column]) -> Column:
    return F.array_compact(F.array(*[F.when(value(c).isNotNull(), F.lit(c)) for c in columns]))


def is_complete(columns: list[str], fields: Column, value: Callable[[str], Column] = F.col) -> Column:
    """No field of the category is null; where ``fields`` is null nothing is known of the category and all columns count."""
    return reduce(lambda a, b: a & b, [value(c).isNotNull() | ~F.coalesce(F.array_contains(fields, c), F.lit(True)) for c in columns])


def sold_capture(
    candidates: DataFrame,
    sold_store: DataFrame,
    numbers: list[str] = ("price", "watch_count", "view_count"),
    key: str = "url",
    tiebreak: list[str] = (),
    category: str = "category_num",
    fields: DataFrame | None = None,
) -> DataFrame:
    """New sold rows: sold by status, not stored, complete, numbers parsed, latest per key.

    Complete means without a null in the fields of the row's category, which `fields` names (see `category_fields`). A row without
    a category there, and every row where `fields` is left out, must fill all columns. So what happens to a row
    does not depend on the other candidates.
    """
    sold = new_rows(candidates.where(looks_sold()), sold_store, key)
    if fields is None:
        sold = sold.na.drop("any")
    else:
        known = sized_broadcast(fields.select(F.col("category").alias("_of"), F.col("fields").alias("_fields")))
        sold = sold.join(known, F.col(category).eqNullSafe(F.col("_of")), "left")
        sold = sold.where(is_complete(candidates.columns, F.col("_fields"))).select(*candidates.columns)
    return latest_row(C.convert_to_float(sold, list(numbers)), key, "datetime_scraped", tiebreak)


def removal_set(stored: DataFrame, listed: DataFrame, sold_store: DataFrame, key: str = "url") -> DataFrame:
    """Stored rows to delete: no longer listed, or already stored as sold."""
    gone = vanished_rows(stored, listed, key).select(key)
    return known_rows(stored, gone.unionByName(sold_store.select(key)), key)


SITE_ZONE = "America/Denver"


def dated_price_drops(changes: DataFrame, key: str = "url") -> DataFrame:
    """Price falls with their amount and day, numbers compared as numbers."""
    old, new = C.digits_to_double("old_value"), C.digits_to_double("new_value")
    drops = changes.where((F.col("field") == "price") & (new < old))
    return drops.select(key, (old - new).alias("price_change"), F.col("update_date").cast("date").alias("drop_day"))


def price_drops(changes: DataFrame, since: Column | None = None, key: str = "url", zone: str = SITE_ZONE) -> DataFrame:
    """Price falls with their amount, from the day that `since` is in the site's zone."""
    drops = dated_price_drops(changes, key)
    if since is not None:
        drops = drops.where(F.col("drop_day") >= F.from_utc_timestamp(since, zone).cast("date"))
    return drops.drop("drop_day")
