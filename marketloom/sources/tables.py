"""Scans and sinks of the listing store, files and databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import digits_to_double, normalize_names
from ..operators.filters import by_category_region


def get_dataset(
    spark: SparkSession, root: str, data_type: str, category_num: int | None = -1, region_code: int | None = None
) -> DataFrame:
    """One stored table with optional equality filters, which reach the scan."""
    if data_type not in schemas.DATA_TYPES:
        raise ValueError(f"data_type should be one of {sorted(schemas.DATA_TYPES)}")
    if region_code not in (3, 5, None):
        raise ValueError("region_code should be one of 3, 5 or None")
    df = spark.read.schema(schemas.DATA_TYPES[data_type]).parquet(f"{root}/{data_type}")
    return by_category_region(df, category_num, region_code)


def write_dataset(df: DataFrame, root: str, data_type: str, mode: str = "overwrite") -> None:
    """Write a stored table, partitioned by category so that one category reads only its files."""
    if data_type not in schemas.DATA_TYPES:
        raise ValueError(f"data_type should be one of {sorted(schemas.DATA_TYPES)}")
    normalize_names(df).write.mode(mode).partitionBy("category_num").parquet(f"{root}/{data_type}")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Gzip parquet in a directory of its own; versions are never overwritten."""
    path = f"{root}/version={version}"
    df.write.option("compression", "gzip").mode("errorifexists").parquet(path)
    return path


def read_csv_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON table, one array per file or one object per line."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def rows_as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, every field as text and nulls kept."""
    fields = [F.col(c).cast("string").alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_rows_as_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows_as_json(df).write.mode(mode).text(path)


_IF_EXISTS = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_table(
    df: DataFrame, path: str | None = None, if_exists: str = "replace", jdbc: dict | None = None, chunk_size: int = 10_000
) -> None:
    """Publish a table as parquet, or to a database in batches of `chunk_size` rows."""
    if if_exists not in _IF_EXISTS:
        raise ValueError(f"if_exists should be one of {sorted(_IF_EXISTS)}")
    writer = df.write.mode(_IF_EXISTS[if_exists])
    if jdbc:
        writer.format("jdbc").option("batchsize", chunk_size).options(**jdbc).save()
    else:
        writer.parquet(path)


def query(spark: SparkSession, text: str, params: dict, **tables: DataFrame) -> DataFrame:
    """SQL text with bound parameters; tables are passed by name and never spliced into the text."""
    return spark.sql(text, args=params, **tables)


def daily_table(df_builder, spark: SparkSession, root: str, day: str) -> DataFrame:
    """Today's table if it is complete, else build, write and read it back."""
    path = f"{root}/dt={day}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df_builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def daily_listing_table(spark: SparkSession, root: str, day: str, build) -> DataFrame:
    """Daily listing table with its counts and price as numbers."""
    numbers = ["price", "watch_count", "view_count"]

    def typed() -> DataFrame:
        df = build()
        for c in numbers:
            df = df.where(F.coalesce(F.col(c).cast("string"), F.lit("0")).rlike(r"[\d.]"))
        return df.withColumns({c: digits_to_double(c) for c in numbers})

    return daily_table(typed, spark, root, day)


def read_pages(spark: SparkSession, path: str, columns: list[str] = ("page_id", "url", "html")) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, schemas.ALERT)


def stamp_alert(alerts: DataFrame, uuid: str, now: Column | None = None) -> DataFrame:
    moment = F.current_timestamp() if now is None else now
    return alerts.withColumn("last_checked", F.when(F.col("uuid") == uuid, moment).otherwise(F.col("last_checked")))
