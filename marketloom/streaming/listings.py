"""Streaming forms of the latest-row table, change log, daily counts and alerts.

Sinks are files in the shared folder, one directory per micro-batch, so a batch
that is retried replaces its own output. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.windows import latest_row


def read_stream(spark: SparkSession, path: str, schema, ts: str, max_files: int | None = None) -> DataFrame:
    """File stream with its event time as an instant."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def _run(writer, folder: str) -> StreamingQuery:
    return writer.option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()


def to_files(df: DataFrame, folder: str) -> StreamingQuery:
    """Append-mode parquet sink."""
    return _run(df.writeStream.format("parquet").option("path", f"{folder}/data").outputMode("append"), folder)


def latest_updates(stream: DataFrame, key: str, ts: str, tiebreak: str) -> DataFrame:
    """Latest row per key as a streaming aggregate; each task reduces its rows to one per key first."""
    row = F.struct(*stream.columns)
    best = F.max_by(row, F.struct(F.col(ts), F.col(tiebreak))).alias("row")
    return stream.groupBy(key).agg(best).select("row.*")


def maintain_latest(stream: DataFrame, key: str, ts: str, tiebreak: str, folder: str) -> StreamingQuery:
    """Keep a latest-row table as a log of updated rows; `read_latest` resolves it.

    The state holds one row per key for good, as such a table must: set the
    RocksDB state store where keys do not fit in memory, and compact the log now and then.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    updates = latest_updates(stream, key, ts, tiebreak)
    return _run(updates.writeStream.outputMode("update").foreachBatch(append), folder)


def read_latest(spark: SparkSession, folder: str, key: str, ts: str, tiebreak: str) -> DataFrame:
    log = spark.read.parquet(f"{folder}/data")
    return latest_row(log, key, ts, [tiebreak, "batch"]).drop("batch")


def compact_latest(spark: SparkSession, folder: str, target: str, key: str, ts: str, tiebreak: str) -> None:
    """Rewrite the log as one row per key in a new folder."""
    read_latest(spark, folder, key, ts, tiebreak).withColumn("batch", F.lit(0)).write.partitionBy("batch").parquet(f"{target}/data")


def log_changes(stream: DataFrame, key: str, ts: str, tiebreak: str, columns: list[str], folder: str) -> StreamingQuery:
    """Change log of every arriving row against the previous row of its key: (key, ts, tiebreak, field, old_value, new_value).

    The last row of each key is keyed state in RocksDB: a micro-batch looks up the keys that it holds and nothing else, however long the
    stream has run, and the state may outgrow memory. Values are compared and logged as text. A row older than the last one of its key is compared with
    the rows of its own micro-batch before it, and leaves the state as it is. The rows that one key has in a micro-batch meet in one task: bound the
    micro-batches where keys are busy (`read_stream`'s `max_files`).
    """
    spark = stream.sparkSession
    named = stream.select(
        F.col(key).alias("key"), F.unix_micros(ts).alias("at"), F.col(tiebreak).alias("tie"), *[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]
    )
    kinds = dict(named.dtypes)
    out = f"key {kinds['key']}, at bigint, tie {kinds['tie']}, field string, old_value string, new_value string"
    state = ", ".join(f"{c} {kind}" for c, kind in kinds.items() if c != "key")
    told = named.groupBy("key").transformWithStateInPandas(LastRow(columns, state), out, "Append", "None")
    log = told.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("tie").alias(tiebreak), "field", "old_value", "new_value")
    with _rocksdb(spark):  # a query keeps the settings with which it starts
        return to_files(log, folder)


class LastRow(StatefulProcessor):
    """Keeps the last row of a key and compares the rows that arrive in the order of time and tiebreak."""

    def __init__(self, columns: list[str], schema: str):
        self.columns, self.schema = columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        values = [f"v{i}" for i in range(len(self.columns))]
        arrived = pd.concat([part[["at", "tie", *values]] for part in rows], ignore_index=True).assign(old=False)
        if self.last.exists():
            held = pd.DataFrame([self.last.get()], columns=["at", "tie", *values]).assign(old=True)
            arrived = pd.concat([held, arrived], ignore_index=True)
        ordered = arrived.sort_values(["at", "tie"], kind="stable", na_position="first", ignore_index=True)
        newest = ordered.iloc[-1]
        if not newest["old"]:
            self.last.update(tuple(None if pd.isna(x) else getattr(x, "item", lambda x=x: x)() for x in newest[["at", "tie", *values]]))
        fresh = ~ordered["old"].to_numpy(bool)
        fresh[0] = False
        for name, column in zip(self.columns, values):
            now = ordered[column].astype(object)
            now = now.where(now.notna(), None)
            before = now.shift(1)
            before = before.where(before.notna(), None)
            differs = fresh & ~((now == before) | (now.isna() & before.isna())).to_numpy(bool)
            if differs.any():
                yield pd.DataFrame({"key": key[0], "at": ordered["at"][differs], "tie": ordered["tie"][differs], "field": name, "old_value": before[differs], "new_value": now[differs]})

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """Queries that start within it keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def drop_late(stream: DataFrame, ts: str, key: list[str], hours: int = 48) -> DataFrame:
    """First copy of each row; rows more than `hours` behind the newest event are dropped.

    The limit counts from the newest event of the micro-batches before the
    previous one, not from the last run.
    """
    return stream.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark(key)


def daily_counts(stream: DataFrame, ts: str, category: str, hours: int = 48) -> DataFrame:
    """Rows per day and category, emitted once a day can no longer change."""
    windowed = stream.withWatermark(ts, f"{hours} hours").groupBy(F.window(ts, "1 day"), category)
    counts = windowed.agg(F.count(F.lit(1)).alias("count_ads"))
    return counts.select(F.col("window.start").cast("date").alias("post_day"), F.col("window.end").alias("day_end"), category, "count_ads")


def match_alerts(stream: DataFrame, rules: DataFrame, ts: str, key: list[str], on: str, condition, hours: int = 48) -> DataFrame:
    """Repeated rows dropped, then joined to a static rule table."""
    fresh = stream.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark(key)
    return fresh.join(rules, on).where(condition)
