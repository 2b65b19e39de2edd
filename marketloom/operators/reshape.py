"""Pivot, melt and nested-map reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_counts(df: DataFrame, rows: str, column: str, values: list, measure: Column, fill: int | None = 0) -> DataFrame:
    """One row per `rows`, one column per listed value; listing them avoids a pass over the data."""
    wide = df.groupBy(rows).pivot(column, values).agg(measure)
    return wide.na.fill(fill) if fill is not None else wide


def order_by_row_total(wide: DataFrame, rows: str) -> DataFrame:
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in wide.columns if c != rows), F.lit(0))
    return wide.withColumn("row_total", total).orderBy(F.desc("row_total"), rows)


def melt(df: DataFrame, ids: list[str], name: str, value: str, columns: list[str] | None = None) -> DataFrame:
    return df.unpivot(ids, columns or [c for c in df.columns if c not in ids], name, value)


def label_values_to_row(long: DataFrame, key: str, labels: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """Label/value rows to one wide row per key for the listed labels."""
    return long.groupBy(key).pivot(label, labels).agg(F.min(value))


def label_values_to_map(long: DataFrame, key: str, label: str = "label", value: str = "value") -> DataFrame:
    """Label/value rows to one map per key; one value per label is kept before collecting."""
    single = long.groupBy(key, label).agg(F.min(value).alias(value))
    return single.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, value)))).alias("values"))


def suffix_labels(long: DataFrame, table_no: str = "table_no", label: str = "label", suffix: str = "_summary") -> DataFrame:
    """Mark the labels of a page's first table."""
    return long.withColumn(label, F.when(F.col(table_no) == 0, F.concat(label, F.lit(suffix))).otherwise(F.col(label)))


def nested_catalogue(df: DataFrame, year: str, maker: str, model: str) -> DataFrame:
    """year -> (maker -> sorted distinct models), one row per year.

    Distinct first, so what is collected is the catalogue and not the rows.
    """
    models = df.select(year, maker, model).distinct()
    makers = models.groupBy(year, maker).agg(F.array_sort(F.collect_list(model)).alias("models"))
    return makers.groupBy(year).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(maker, "models")))).alias("makers")
    )


def flatten_catalogue(nested: DataFrame, year: str, maker: str, model: str) -> DataFrame:
    makers = nested.select(year, F.explode("makers").alias(maker, "_models"))
    return makers.select(year, maker, F.explode("_models").alias(model))
