"""Readers of price-index files; each returns (year, cpi, most_recent_cpi, currency)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.aggregates import yearly_mean_with_latest
from ..operators.reshape import melt

# The series of interest in each file.
US_SERIES = "CUSR0000SA0"
CANADA_PRODUCT = "All-items"
EU_SERIES = "A,INX_A_AVG,CP00,EA19"
EU_KEY_COLUMN = "freq,unit,coicop,geo\\TIME_PERIOD"
UK_CPI_COLUMN = "CPI INDEX 00: ALL ITEMS 2015=100"


def _finish(df: DataFrame, currency: str) -> DataFrame:
    return df.select(
        F.col("year").cast("int").alias("year"), F.col("cpi").cast("double").alias("cpi"),
        F.col("most_recent_cpi").cast("double").alias("most_recent_cpi"), F.lit(currency).alias("currency"),
    )


def _with_latest(df: DataFrame) -> DataFrame:
    """Attach the value of the latest year that has one."""
    latest = F.max_by("cpi", F.when(F.col("cpi").isNotNull(), F.col("year")))
    return df.withColumn("most_recent_cpi", df.agg(latest).scalar())


def read_us(spark: SparkSession, path: str, series: str = US_SERIES) -> DataFrame:
    """Tab-separated monthly values; padded series names; yearly means."""
    raw = (
        spark.read.schema(schemas.CPI_US).option("sep", "\t").option("header", True).option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    )
    wanted = raw.where(F.trim("series_id") == series)
    return _finish(yearly_mean_with_latest(wanted, [], "year", "cpi"), "USD")


def read_canada(spark: SparkSession, path: str, product: str = CANADA_PRODUCT) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    wanted = raw.where(F.col("Products and product groups") == product)
    df = wanted.select(F.col("REF_DATE").try_cast("int").alias("year"), F.col("VALUE").try_cast("double").alias("cpi"))
    return _finish(_with_latest(df), "CAD")


def read_euro(spark: SparkSession, path: str, series: str = EU_SERIES, key_column: str = EU_KEY_COLUMN) -> DataFrame:
    """Gzip tab-separated file with one column per year."""
    wide = (
        spark.read.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True).csv(path)
    )
    years = [c for c in wide.columns if c != key_column]
    wide = wide.toDF(*["region" if c == key_column else c.strip() for c in wide.columns])
    long = melt(wide.where(F.trim("region") == series), ["region"], "year", "cpi", [y.strip() for y in years])
    df = long.select(F.col("year").cast("int"), F.regexp_extract("cpi", r"[\d.]+", 0).try_cast("double").alias("cpi"))
    return _finish(_with_latest(df), "EUR")


def read_uk(spark: SparkSession, path: str, column: str = UK_CPI_COLUMN) -> DataFrame:
    """Sectioned file: notes, then yearly, quarterly and monthly rows; yearly rows have a bare year."""
    pattern = r'^"?(\d{4})"?\s*,\s*"?([\d.]+)"?\s*$'
    lines = spark.read.text(path)
    df = lines.where(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).cast("int").alias("year"),
        F.regexp_extract("value", pattern, 2).cast("double").alias("cpi"),
    )
    return _finish(_with_latest(df), "GBP")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "united-states": read_us,
    "canada": read_canada,
    "eu": read_euro,
    "uk": read_uk,
}


def read_index(spark: SparkSession, region: str, path: str) -> DataFrame:
    if region not in READERS:
        raise ValueError(f"Region must be one of {list(READERS)}")
    return READERS[region](spark, path).withColumn("region", F.lit(region))
