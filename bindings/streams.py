"""T group: events as a file stream, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.session import shared_folder
from marketloom.streaming import listings as S

from .inputs import Registry, Tables

q = Registry()


def event_stream(t: Tables):
    return S.read_stream(t.spark, f"{t.folder}/events.parquet*", t.events.schema, "ts")


def run(query):
    query.awaitTermination()


# Events arrive in thirds of their time; those with late = true, one third later than they should.
ARRIVALS = """with span as (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events),
arrived as (select e.*, least(2, 3 * (epoch_us(ts) - lo) // (hi - lo + 1)) + case when event_id % 10 = 1 then 1 else 0 end as arrival from events e, span)
"""


def arrivals(t: Tables, late: bool) -> list:
    """The events of each arrival, from the first to the last."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = t.events.agg(F.min(micros), F.max(micros)).first()
    third = F.least(F.lit(2), F.floor(3 * (micros - lo) / (hi - lo + 1)))
    number = third + F.when((F.col("event_id") % 10 == 1) & F.lit(late), 1).otherwise(0)
    return [t.events.where(number == i) for i in range(4 if late else 3)]


def run_arrivals(t: Tables, purpose: str, late: bool, start) -> str:
    """Each arrival is written to the source's folder and the stream is run to its end, from the checkpoint of the run before."""
    source, folder = shared_folder(t.spark, f"{purpose}-source"), shared_folder(t.spark, purpose)
    for part in arrivals(t, late):
        part.write.mode("append").parquet(source)
        run(start(S.read_stream(t.spark, source, t.events.schema, "ts"), folder))
    return folder


@q("t01_stream_latest", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def t01(t: Tables):
    folder = shared_folder(t.spark, "latest")
    run(S.maintain_latest(event_stream(t), "user_id", "ts", "event_id", folder))
    return S.read_latest(t.spark, folder, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@q("t02_stream_changelog", """with p as (select user_id, event_id, event_type, value, lag(event_id) over w as prev, lag(event_type) over w as old_type, lag(value) over w as old_value from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id, 'event_type' as field, old_type as old_value, event_type as new_value from p where prev is not null and old_type is distinct from event_type""")
def t02(t: Tables):
    folder = run_arrivals(t, "changes", False, lambda events, folder: S.log_changes(events, "user_id", "ts", "event_id", ["event_type"], folder))
    return t.spark.read.parquet(f"{folder}/data").select("user_id", "event_id", "field", "old_value", "new_value")


@q("t03_stream_late_rows", ARRIVALS + """, tops as (select arrival, max(epoch_ms(ts)) as top from arrived group by arrival),
marks as (select arrival, max(top) over (order by arrival rows between unbounded preceding and 1 preceding) - 48 * 3600000 as mark from tops)
select event_id, event_type from arrived join marks using (arrival) where mark is null or epoch_us(ts) > 1000 * mark""")
def t03(t: Tables):
    """A tenth of the events come a third of the time late; what is 48 hours or more behind the newest event of earlier arrivals is dropped."""
    folder = run_arrivals(t, "late", True, lambda events, folder: S.to_files(S.drop_late(events, "ts", ["event_id"]), folder))
    return t.spark.read.parquet(f"{folder}/data").select("event_id", "event_type")


@q("t04_stream_daily_counts", "select cast(cast(ts as date) as string) as post_day, event_type, count(*) as count_ads from events where cast(ts as date) + interval 1 day <= (select max(ts) - interval 48 hour from events) group by 1, 2")
def t04(t: Tables):
    folder = shared_folder(t.spark, "daily-counts")
    run(S.to_files(S.daily_counts(event_stream(t), "ts", "event_type"), folder))
    return t.spark.read.parquet(f"{folder}/data").select(F.col("post_day").cast("string").alias("post_day"), "event_type", "count_ads")


@q("t05_stream_alerts", "select event_id, event_type, value from events join (select event_type, avg(value) * 2 as floor_value from events group by 1) using (event_type) where value > floor_value")
def t05(t: Tables):
    folder = shared_folder(t.spark, "matched")
    rules = t.events.groupBy("event_type").agg((F.avg("value") * 2).alias("floor_value"))
    matched = S.match_alerts(event_stream(t), rules, "ts", ["event_id"], "event_type", F.col("value") > F.col("floor_value"))
    run(S.to_files(matched, folder))
    return t.spark.read.parquet(f"{folder}/data").select("event_id", "event_type", "value")
