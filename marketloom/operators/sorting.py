"""Ordering, top-k and exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def top_k(df: DataFrame, by: str, k: int, nulls: str = "last", tiebreak: list[str] = ()) -> DataFrame:
    """Largest k rows; each task keeps k rows and only those travel."""
    lead = F.desc_nulls_first(by) if nulls == "first" else F.desc_nulls_last(by)
    return df.orderBy(lead, *tiebreak).limit(k)


def top_k_of_many(df: DataFrame, by: str, k: int, tiebreak: list[str] = ()) -> DataFrame:
    """Largest k rows for a k in the thousands.

    A plain top-k sends k rows per task to one place. Here a sketch quantile
    gives a floor with at least k rows above it (counted; else no floor), so
    only about k rows travel. The result is the same. `df` is read several
    times: pass a table or something cheap.
    """
    n = df.count()
    share = 1 - k / max(n, 1) - 3e-4
    if share > 0:
        floor = df.agg(F.percentile_approx(by, share, 10_000)).first()[0]
        above = df.where(F.col(by) >= F.lit(floor))
        if above.limit(k).count() == k:
            df = above
    return top_k(df, by, k, tiebreak=tiebreak)


def sort_mixed(df: DataFrame, descending: list[str], ascending: list[str]) -> DataFrame:
    """Descending keys then ascending keys, nulls last in both directions."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in descending], *[F.asc_nulls_last(c) for c in ascending])


def largest_groups(df: DataFrame, key: str, item: str, n: int = 10) -> DataFrame:
    """n groups with most distinct items, ties by name."""
    counted = df.groupBy(key).agg(F.countDistinct(item).alias("n_items"))
    return counted.orderBy(F.desc("n_items"), key).limit(n)


def largest_absolute(df: DataFrame, column: str, n: int = 20, tiebreak: list[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(F.abs(column)), *tiebreak).limit(n)


def hashed_order(key: str, seed: int = 42) -> Column:
    """A repeatable pseudo-random order of keys, the same under any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), repeatable for a seed: those with the smallest hashed keys.

    For a large n a bound on the hash is put in front, wide enough to hold n rows
    (counted; else no bound), so that tasks do not send n rows each.
    """
    if n >= 1_000:
        share = (n + 6 * n**0.5 + 10) / max(df.count(), 1)
        if share < 1:
            near = df.where(F.conv(F.substring(hashed_order(key, seed), 1, 8), 16, 10).cast("bigint") < int(share * 2**32))
            if near.limit(n).count() == n:
                df = near
    return df.orderBy(hashed_order(key, seed), key).limit(n)


def coefficient_table(df: DataFrame, name_part: str, n: int = 50) -> DataFrame:
    """Coefficients whose feature name holds a text, by absolute size."""
    ranked = df.where(F.col("feature").contains(name_part)).withColumn("abs_importance", F.abs("importance"))
    return ranked.orderBy(F.desc("abs_importance"), "feature").limit(n)


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest on ties; null is not counted."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(1)


CELLS = 4_096


def exact_quantiles(
    df: DataFrame, columns: list[str], shares: list[float] = (0.5,), accuracy: int = 10_000, whole_below: int = 100_000
) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns, interpolated between the two nearest ranks.

    Nulls and NaN are not counted; a column without values gives None. `df` is
    read twice, for any number of columns and shares. The first pass is one
    aggregate: mergeable sketches bracket each wanted rank (a column of up to
    `whole_below` values needs none, its bracket is its range). The second pass
    counts the rows below each bracket and the values inside it; see `_settle`.
    """
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    rows = df.select(*[v.alias(f"v{i}") for i, v in enumerate(numbers)])
    margin = 4 / accuracy  # a sketch errs by one part in `accuracy`, its merges by no more than twice that
    marks = [min(max(s + side, 0.0), 1.0) for s in shares for side in (-margin, margin)]
    found = rows.agg(
        *[
            F.struct(
                F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, marks, accuracy).alias("marks")
            ).alias(v)
            for v in rows.columns
        ]
    ).first()
    slots, wanted = [], {}
    for v, (n, low, high, bounds) in zip(rows.columns, found):
        for j, share in enumerate(shares):
            if not n:
                continue
            place = share * (n - 1)
            wanted[v, j] = (place, len(slots))
            bracket = (low, high) if n <= whole_below else (bounds[2 * j], bounds[2 * j + 1])
            slots.append((v, *bracket, int(place) + 1, min(int(place) + 2, n)))
    ranks = _settle(rows, slots) if slots else {}
    missed = [i for i, slot in enumerate(slots) if not {slot[3], slot[4]} <= ranks[i].keys()]
    if missed:  # a sketch beyond its stated error: take the whole range of these columns
        bounds = dict(zip(rows.columns, found))
        again = _settle(rows, [(slots[i][0], bounds[slots[i][0]].low, bounds[slots[i][0]].high, *slots[i][3:]) for i in missed])
        ranks.update({i: again[k] for k, i in enumerate(missed)})
    out = {}
    for v, c in zip(rows.columns, columns):
        out[c] = []
        for j in range(len(shares)):
            if (v, j) not in wanted:
                out[c].append(None)
                continue
            place, i = wanted[v, j]
            lower, upper = ranks[i][slots[i][3]], ranks[i][slots[i][4]]
            part = place - int(place)
            out[c].append(lower if lower == upper or not part else lower + (upper - lower) * part)
    return out


def _settle(rows: DataFrame, slots: list[tuple]) -> dict[int, dict[int, float]]:
    """For each slot (column, bracket from, to, two wanted ranks) the values at those ranks, in one pass.

    Rows below the bracket are only counted. The bracket is cut into equal cells;
    equal values combine on the map side, cells are ranked by their counts and
    only the values of the at most two cells that hold a wanted rank are sorted.
    """
    entries = []
    for i, (v, low, high, _, _) in enumerate(slots):
        width = high - low
        even = 0 < width < float("inf")
        cell = F.least(F.floor((F.col(v) - low) / width * CELLS), F.lit(CELLS - 1)) if even else F.lit(0)
        inside = F.col(v) >= low
        entry = F.struct(
            F.lit(i).alias("slot"), F.when(inside, cell).otherwise(-1).cast("int").alias("cell"), F.when(inside, F.col(v)).alias("value")
        )
        entries.append(F.when(F.col(v) <= high, entry))
    found = rows.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    # Written, as cells and values both read it: the brackets' rows, a share of 8 / accuracy of a large column.
    counts = materialize(found.groupBy("slot", "cell", "value").agg(F.count(F.lit(1)).alias("n")), "quantiles")
    first, second = [F.element_at(F.array(*[F.lit(s[k]).cast("long") for s in slots]), F.col("slot") + 1) for k in (3, 4)]
    so_far = F.sum("n").over(Window.partitionBy("slot").orderBy("cell"))
    cells = counts.groupBy("slot", "cell").agg(F.sum("n").alias("n")).withColumn("upto", so_far)
    held = cells.where((F.col("upto") >= first) & (F.col("upto") - F.col("n") < second) & (F.col("cell") >= 0))
    held = held.select("slot", "cell", (F.col("upto") - F.col("n")).alias("before"))
    # Of the cells between the two wanted ranks only the ends hold one; both ranks are neighbours, so two cells at most.
    values = counts.join(F.broadcast(held), ["slot", "cell"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("slot", "cell").orderBy("value"))
    ranked = values.withColumn("upto", upto).withColumn("after", F.col("upto") - F.col("n"))
    found = ranked.select("slot", "value", F.explode(F.array_distinct(F.array(first, second))).alias("rank"), "upto", "after")
    out = {i: {} for i in range(len(slots))}
    for r in found.where((F.col("after") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).collect():
        out[r.slot][r.rank] = r.value
    return out


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, [column])[column][0]
