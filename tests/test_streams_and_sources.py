import gzip
import os

import pytest
from pyspark.sql import functions as F

from marketloom.operators.windows import latest_row
from marketloom.session import shared_folder
from marketloom.sources import indices, tables
from marketloom.streaming import listings as S

from .conftest import rows

SCHEMA = "url string, ts timestamp, id long, price double"


@pytest.fixture
def source(spark, frame):
    """Four files: one micro-batch each; two updates of a url in one file, one row far behind."""
    folder = shared_folder(spark, "source")
    batches = [
        [("a", "2024-01-01 00:00:00", 1, 10.0), ("b", "2024-01-01 01:00:00", 2, 5.0), ("a", "2024-01-01 02:00:00", 3, 9.0)],
        [("a", "2024-01-05 00:00:00", 4, 9.0), ("b", "2024-01-05 00:00:00", 5, 6.0), ("c", "2024-01-05 00:00:00", 6, 1.0)],
        [("c", "2024-01-05 01:00:00", 10, 2.0)],
        [("a", "2024-01-03 01:00:00", 7, 8.0), ("a", "2024-01-06 00:00:00", 8, 7.0), ("a", "2024-01-06 00:00:00", 8, 7.0), ("b", "2024-01-02 23:00:00", 9, 1.0)],
    ]
    for i, batch in enumerate(batches):
        df = frame(batch, "url string, t string, id long, price double").select("url", F.col("t").cast("timestamp").alias("ts"), "id", "price")
        df.coalesce(1).write.mode("append").parquet(folder)
        files = [f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")]
        os.utime(max(files, key=os.path.getctime), (1_700_000_000 + i * 10,) * 2)
    return folder


def stream(spark, source):
    return S.read_stream(spark, source, spark.read.parquet(source).schema, "ts", max_files=1)


def test_latest_table_equals_batch(spark, source):
    folder = shared_folder(spark, "latest")
    S.maintain_latest(stream(spark, source), "url", "ts", "id", folder).awaitTermination()
    expected = latest_row(spark.read.parquet(source), "url", "ts", ["id"])
    got = S.read_latest(spark, folder, "url", "ts", "id")
    assert rows(got, "url", "id", "price") == rows(expected, "url", "id", "price") == [("a", 8, 7.0), ("b", 5, 6.0), ("c", 10, 2.0)]
    target = shared_folder(spark, "compacted")
    S.compact_latest(spark, folder, target, "url", "ts", "id")
    assert rows(S.read_latest(spark, target, "url", "ts", "id"), "url", "id") == [("a", 8), ("b", 5), ("c", 10)]


def test_change_log_over_micro_batches(spark, frame):
    folder, out = shared_folder(spark, "ordered"), shared_folder(spark, "log")
    for i in range(4):
        rows_ = [("a", f"2024-01-0{i + 1} 00:00:00", 10 * i, float(i // 2)), ("a", f"2024-01-0{i + 1} 05:00:00", 10 * i + 1, 9.0)]
        df = frame(rows_, "url string, t string, id long, price double").select("url", F.col("t").cast("timestamp").alias("ts"), "id", "price")
        df.coalesce(1).write.mode("append").parquet(folder)
        files = [f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")]
        os.utime(max(files, key=os.path.getctime), (1_700_000_000 + i * 10,) * 2)
    S.log_changes(stream(spark, folder), "url", "ts", "id", ["price"], out).awaitTermination()
    got = rows(spark.read.parquet(f"{out}/data"), "id", "old_value", "new_value")
    assert sorted(got) == sorted([(1, "0.0", "9.0"), (10, "9.0", "0.0"), (11, "0.0", "9.0"), (20, "9.0", "1.0"), (21, "1.0", "9.0"), (30, "9.0", "1.0"), (31, "1.0", "9.0")])


def test_change_log_after_restarts(spark, frame):
    """One run over all files and a run after each file, from the checkpoint, give the log that a loop over the batches gives."""
    import random

    rng = random.Random(4)
    batches = [[(rng.choice("abc"), rng.randrange(40), 100 * b + i, rng.choice([None, 1.0, 2.0]), rng.choice(["x", "y", None])) for i in range(12)] for b in range(3)]
    want, last = [], {}
    for batch in batches:
        for url in "abc":
            held = [(*last[url], True)] if url in last else []
            ordered = sorted(held + [(*r[1:], False) for r in batch if r[0] == url], key=lambda r: r[:2])
            for before, now in zip(ordered, ordered[1:]):
                if not now[4]:
                    want += [(url, now[1], f, None if b is None else str(b), None if n is None else str(n)) for f, b, n in (("price", before[2], now[2]), ("state", before[3], now[3])) if b != n]
            if ordered:
                last[url] = ordered[-1][:4]
    files, whole, step = (shared_folder(spark, name) for name in ("arrivals", "whole", "step"))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    schema = "url string, ts timestamp, id long, price double, state string"
    for i, batch in enumerate(batches):
        df = frame(batch, "url string, h long, id long, price double, state string").select("url", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "id", "price", "state")
        df.coalesce(1).write.mode("append").parquet(files)
        newest = max((f"{files}/{f}" for f in os.listdir(files) if f.endswith(".parquet")), key=os.path.getctime)
        os.utime(newest, (1_700_000_000 + i * 10,) * 2)
        S.log_changes(S.read_stream(spark, files, schema, "ts"), "url", "ts", "id", ["price", "state"], step).awaitTermination()
    S.log_changes(S.read_stream(spark, files, schema, "ts", max_files=1), "url", "ts", "id", ["price", "state"], whole).awaitTermination()
    read = lambda folder: sorted((tuple(r) for r in spark.read.parquet(f"{folder}/data").select("url", "id", "field", "old_value", "new_value").collect()), key=str)
    assert read(step) == read(whole) == sorted(want, key=str)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    kept = [f for _, _, names in os.walk(f"{step}/_checkpoint/state") for f in names]
    assert any(f.endswith(".zip") or f.endswith(".changelog") for f in kept)


def test_late_rows_are_dropped_at_48_hours(spark, source):
    folder = shared_folder(spark, "late")
    S.to_files(S.drop_late(stream(spark, source), "ts", ["id"]), folder).awaitTermination()
    # For the last file the limit is that of two files before, 5 January 00:00: 47 hours behind stays, 49 hours behind goes.
    assert rows(spark.read.parquet(f"{folder}/data"), "id") == sorted([(i,) for i in [*range(1, 9), 10]], key=str)


def test_daily_counts_close_after_the_watermark(spark, source):
    folder = shared_folder(spark, "daily")
    S.to_files(S.daily_counts(stream(spark, source), "ts", "url"), folder).awaitTermination()
    got = spark.read.parquet(f"{folder}/data")
    assert rows(got.select(F.col("post_day").cast("string"), "url", "count_ads")) == [("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-03", "a", 1)]


def test_alert_matches_once(spark, source, frame):
    folder = shared_folder(spark, "alerts")
    rules = frame([("a", 8.5), ("c", 0.5)], "url string, limit double")
    matched = S.match_alerts(stream(spark, source), rules, "ts", ["id"], "url", F.col("price") < F.col("limit"))
    S.to_files(matched, folder).awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/data"), "url", "id") == [("a", 7), ("a", 8)]


def test_index_readers(spark, tmp_path):
    (tmp_path / "us.tsv").write_text("series_id\tyear\tperiod\tvalue\tfootnote\nCUSR0000SA0      \t2000\tM01\t 10.0\t\nCUSR0000SA0\t2000\tM02\t20.0\t\nCUSR0000SA0\t2001\tM01\t30.0\t\nOTHER\t2002\tM01\t1\t\n")
    assert rows(indices.read_us(spark, str(tmp_path / "us.tsv"))) == [(2000, 15.0, 30.0, "USD"), (2001, 30.0, 30.0, "USD")]
    (tmp_path / "ca.csv").write_text('REF_DATE,GEO,"Products and product groups",VALUE\n2000,C,All-items,5\n2001,C,All-items,6.5\n2001,C,Food,9\n')
    assert rows(indices.read_index(spark, "canada", str(tmp_path / "ca.csv"))) == [(2000, 5.0, 6.5, "CAD", "canada"), (2001, 6.5, 6.5, "CAD", "canada")]
    with gzip.open(tmp_path / "eu.tsv.gz", "wt") as f:
        f.write("freq,unit,coicop,geo\\TIME_PERIOD\t2000 \t2001 \t2002 \nA,INX_A_AVG,CP00,EA19\t100.5 \t101 b\t: \nA,INX_A_AVG,CP00,DE\t1\t1\t1\n")
    assert rows(indices.read_euro(spark, str(tmp_path / "eu.tsv.gz"))) == [(2000, 100.5, 101.0, "EUR"), (2001, 101.0, 101.0, "EUR"), (2002, None, 101.0, "EUR")]
    (tmp_path / "uk.csv").write_text('"Title","CPI INDEX 00: ALL ITEMS 2015=100"\n"CDID","D7BT"\n"Important notes",""\n"2000","72.5"\n"2001","73.4"\n"2000 Q1","72"\n"2000 JAN","71"\n')
    assert rows(indices.read_uk(spark, str(tmp_path / "uk.csv"))) == [(2000, 72.5, 73.4, "GBP"), (2001, 73.4, 73.4, "GBP")]
    with pytest.raises(ValueError):
        indices.read_index(spark, "mars", "x")


def test_store_arguments(spark):
    with pytest.raises(ValueError):
        tables.get_dataset(spark, "x", "other")
    with pytest.raises(ValueError):
        tables.get_dataset(spark, "x", "base", region_code=4)
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), "x", "merge")


def test_table_modes(spark):
    path = shared_folder(spark, "table")
    tables.write_table(spark.range(2), path, "fail")
    with pytest.raises(Exception):
        tables.write_table(spark.range(2), path, "fail")
    tables.write_table(spark.range(3), path, "append")
    assert spark.read.parquet(path).count() == 5


def test_category_filter_prunes_partitions(spark, frame):
    root = shared_folder(spark, "store")
    df = frame([("a", 1, 3), ("b", 2, 5)], "url string, category_num int, region_code int")
    tables.write_dataset(df, root, "base")
    found = tables.get_dataset(spark, root, "base", 1, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category_num" in plan and "PushedFilters: [IsNotNull(region_code)" in plan
    assert rows(found, "url") == [("a",)]


def test_json_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"url": "u", "n": 1}, {"url": "w"}]')
    assert rows(tables.read_json_table(spark, str(tmp_path), "url string, n int")) == [("u", 1), ("w", None)]


def test_rows_as_json_keeps_nulls(frame):
    df = frame([(1, None)], "a int, b string")
    assert tables.rows_as_json(df).first()[0] == '{"a":"1","b":null}'
