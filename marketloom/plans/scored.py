"""Scored listings: the table that search reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..operators import filters, joins
from ..session import sized_broadcast


def convert_currency(df: DataFrame, price: str, currency: str, rates: DataFrame, output: str, to_cad: bool = True) -> DataFrame:
    """Price in another currency by a table (currency, rate_to_cad); CAD is unchanged, an unknown currency gives null."""
    table = rates.select(F.col("currency").alias("_currency"), F.col("rate_to_cad").alias("_rate"))
    joined = df.join(sized_broadcast(table), F.col(currency) == F.col("_currency"), "left")
    rate = F.when(F.col(currency) == "CAD", F.lit(1.0)).otherwise(F.col("_rate"))
    value = F.col(price) * rate if to_cad else F.try_divide(F.col(price), rate)
    return joined.withColumn(output, value).drop("_currency", "_rate")


def scored_listings(
    listings: DataFrame, rates: DataFrame, places: DataFrame, predict: Callable[[DataFrame], DataFrame], model_uuid: str
) -> DataFrame:
    """Bike listings with prediction, both currencies, coordinates and normalised sizes.

    `predict` adds `predicted_price_cad` to its input.
    """
    rows = listings.where(filters.names_bikes())
    travel = ("front_travel", "rear_travel")
    rows = rows.withColumns({c: F.coalesce(C.first_number(c), F.lit(0.0)) for c in travel})
    rows = predict(filters.currency_not(rows, "zl"))
    rows = convert_currency(rows, "price", "currency", rates, "price_cad")
    rows = convert_currency(rows, "predicted_price_cad", "currency", rates, "predicted_price", to_cad=False)
    rows = rows.withColumns(
        {
            "predicted_price_diff": F.col("predicted_price") - F.col("price"),
            "model_uuid": F.lit(model_uuid),
            "material": F.trim("material"),
        }
    )
    rows = joins.attach_coordinates(rows, places)
    return joins.fixed_lookup(rows, fv.FRAME_SIZES, F.trim("frame_size"), "frame_size_normalized")
