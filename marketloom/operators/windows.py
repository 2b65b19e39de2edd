"""Latest-row, ranking, fill and prefix operators.

A window over a key would put a key with a third of the rows into one task.
Here row numbers are only used with a bound (Spark then trims each map task
before the shuffle); every other case is an aggregate, which combines on the
map side, joined back on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sized_broadcast


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First n rows per key; the bound lets each map task drop the rest before the shuffle."""
    name = rank or "_rank"
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"  # beyond it Spark would not trim
    if n > int(df.sparkSession.conf.get(limit)):
        df.sparkSession.conf.set(limit, str(n))
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def latest_row(df: DataFrame, key: str = "url", ts: str = "datetime_scraped", tiebreak: list[str] = ()) -> DataFrame:
    """One latest row per key; rows without a time lose, ties go to the largest tiebreak."""
    return top_n(df, [key], [F.desc_nulls_last(ts), *[F.desc_nulls_last(c) for c in tiebreak]])


def latest_on_both(df: DataFrame, key: str = "url", first: str = "last_repost_date", second: str = "datetime_scraped") -> DataFrame:
    """Rows that are latest by both times; ties stay, and a key whose maxima differ vanishes."""
    tops = df.groupBy(key).agg(F.max(first).alias("_first"), F.max(second).alias("_second"))
    joined = df.join(tops, key)
    return joined.where((F.col(first) == F.col("_first")) & (F.col(second) == F.col("_second"))).drop("_first", "_second")


def with_group_total(df: DataFrame, keys: list[str], total: Column, name: str) -> DataFrame:
    """Attach an aggregate of the row's group; few groups are broadcast, so the rows stay where they are."""
    return df.join(sized_broadcast(df.groupBy(*keys).agg(total.alias(name))), keys)


def with_group_size(df: DataFrame, keys: list[str], name: str = "group_size") -> DataFrame:
    return with_group_total(df, keys, F.count(F.lit(1)), name)


TIME_UNITS = ["month", "day", "hour", "minute", "second"]


def time_unit(df: DataFrame, keys: list[str], ts: str, max_rows: int = 2_000_000) -> str:
    """The coarsest time unit in which no (key, unit) holds more than `max_rows` rows.

    Counts combine on the map side, so looking is cheap; a key with a third of
    all rows gets a fine unit and is spread over as many tasks.
    """
    for unit in TIME_UNITS[:-1]:
        sizes = df.groupBy(*keys, F.date_trunc(unit, ts)).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= max_rows:
            return unit
    return TIME_UNITS[-1]


# Coarser units over each unit of `time_unit`: a second meets at most 3,600 others of its hour, an hour 744 of its month.
UNITS_ABOVE = {"second": ["hour", "month"], "minute": ["day", "year"], "hour": ["month"], "day": ["year"], "month": []}


def time_levels(ts: str, unit: str) -> list[Column]:
    """The buckets of a time, finest first, for the carries below."""
    return [F.date_trunc(u, ts) for u in [unit, *UNITS_ABOVE[unit]]]


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def carry_in(summaries: DataFrame, keys: list[str], levels: list[str], states: list[str]) -> DataFrame:
    """Replace each bucket's states by the last non-null ones of its key's earlier buckets.

    `summaries` holds one row per key and buckets, `levels` names its bucket
    columns from fine to coarse. A window runs over the buckets of one coarser
    bucket only; what comes from before that is carried in from the coarser
    level, which is worked out in the same way. So a task holds the buckets of
    one coarser bucket at a time, however many a key has in all.
    """
    fine, above = levels[0], levels[1:]
    scope = [*keys, *above[:1]]
    before = Window.partitionBy(*scope).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    near = summaries.withColumns({s: F.last(s, ignorenulls=True).over(before) for s in states})
    if not above:
        return near
    tops = [F.max_by(F.col(s), F.when(F.col(s).isNotNull(), F.struct(fine))).alias(s) for s in states]
    far = carry_in(summaries.groupBy(*keys, *above).agg(*tops), keys, above, states)
    joined = near.join(far, _same(near, far, [*keys, *above]), "left")
    return joined.select(
        *[near[c] for c in [*keys, *levels]], *[F.coalesce(near[s], far[s]).alias(s) for s in states]
    )


def _levels(bucket: Column | list[Column]) -> dict[str, Column]:
    found = bucket if isinstance(bucket, list) else [bucket]
    return {f"_bucket{i}": c for i, c in enumerate(found)}


def forward_fill(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: Column | list[Column] | None = None
) -> DataFrame:
    """Carry the last non-null value forward per key.

    With `bucket` (a coarse, order-preserving column, or several from fine to
    coarse) the fill runs per (key, bucket); only one summary row per bucket is
    carried across buckets, level by level.
    """
    if bucket is None:
        run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in columns})
    levels = _levels(bucket)
    keyed = df.withColumns(levels)
    inside = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    last = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_carry_{c}") for c in columns
    ]
    summaries = keyed.groupBy(*keys, *levels).agg(*last)
    carry = carry_in(summaries, keys, list(levels), [f"_carry_{c}" for c in columns])
    joined = local.join(carry, _same(local, carry, [*keys, *levels]), "left")
    filled = {c: F.coalesce(local[c], carry[f"_carry_{c}"]) for c in columns}
    return joined.select(*[filled.get(c, local[c]).alias(c) for c in df.columns])


def previous_row(
    df: DataFrame, key: str, order: list[str], columns: list[str], bucket: Column | list[Column]
) -> DataFrame:
    """Attach the previous row's columns per key (null for the first row), bucket by bucket as in `forward_fill`."""
    levels = _levels(bucket)
    keyed = df.withColumns(levels)
    inside = Window.partitionBy(key, *levels).orderBy(*order)
    state = F.struct(*[F.col(c).alias(c) for c in columns])
    local = keyed.withColumn("_previous", F.lag(state).over(inside))
    summaries = keyed.groupBy(key, *levels).agg(F.max_by(state, F.struct(*order)).alias("_carry"))
    carry = carry_in(summaries, [key], list(levels), ["_carry"])
    out = local.join(carry, _same(local, carry, [key, *levels]), "left")
    previous = F.coalesce("_previous", "_carry")
    return out.select(*[local[c] for c in df.columns], *[previous[c].alias(f"previous_{c}") for c in columns])


def resample_months(df: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """One row per key and month between its first and last month; gaps hold null."""
    spans = df.groupBy(*keys).agg(F.min(month).alias("_from"), F.max(month).alias("_to"))
    months = F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias(month)
    return spans.select(*keys, months).join(df.select(*keys, month, value), [*keys, month], "left")


def complete_grid(df: DataFrame, key: str, year: str, end_year: int) -> DataFrame:
    """Every key with every year from the first known year to `end_year`, left joined to the data."""
    first_year = df.agg(F.min(year)).scalar()
    years = F.explode(F.sequence(first_year.cast("int"), F.lit(end_year))).alias(year)
    return df.select(key).distinct().select(key, years).join(df, [key, year], "left")


def take_while(df: DataFrame, keys: list[str], order: list[str], stop: Column) -> DataFrame:
    """Rows before the first stop row of each key.

    The cut is the smallest stop position, an aggregate that combines on the
    map side; no task ever holds a whole group.
    """
    position = F.struct(*order)
    cuts = df.groupBy(*keys).agg(F.min(F.when(stop, position)).alias("_cut"))
    joined = df.join(sized_broadcast(cuts), keys)
    return joined.where(F.col("_cut").isNull() | (position < F.col("_cut"))).drop("_cut")
