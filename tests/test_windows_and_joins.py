import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import geo, joins, windows
from marketloom.plans import price_history

from .conftest import rows


def stamped(frame, data, schema="url string, ts string, v int"):
    return frame(data, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def test_latest_row_ties_and_nulls(frame):
    df = stamped(frame, [("a", "2021-01-01 00:00:00", 1), ("a", "2021-01-01 00:00:00", 2), ("a", None, 9), ("b", None, 3)])
    assert rows(windows.latest_row(df, "url", "ts", ["v"]), "url", "v") == [("a", 2), ("b", 3)]


def test_same_instant_in_two_zones_is_a_tie(frame):
    df = stamped(frame, [("a", "2024-08-16 10:00:00-06:00", 1), ("a", "2024-08-16 16:00:00+00:00", 2)])
    assert rows(windows.latest_row(df, "url", "ts", ["v"]), "v") == [(2,)]


def test_latest_on_both_drops_disagreement_and_keeps_ties(frame):
    data = [("a", 2, 1), ("a", 1, 2), ("b", 5, 5), ("b", 5, 5), ("c", None, 4)]
    df = frame(data, "url string, last_repost_date int, datetime_scraped int")
    assert rows(windows.latest_on_both(df), "url") == [("b",), ("b",)]


def test_latest_row_is_trimmed_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("url"), F.col("id").alias("ts"))
    plan = windows.latest_row(df, "url", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def naive_fill(data):
    last, out = {}, {}
    for key, t, v in sorted(data, key=lambda r: (r[0], r[1])):
        if v is not None:
            last[key] = v
        out[(key, t)] = last.get(key)
    return out


@pytest.mark.parametrize("bucketed", [False, True])
def test_forward_fill(frame, bucketed):
    random.seed(4)
    times = random.sample(range(1000), 200)
    data = [(random.choice("ab"), t, random.choice([None, None, t])) for t in times]
    bucket = F.floor(F.col("t") / 50) if bucketed else None
    out = windows.forward_fill(frame(data, "k string, t int, v int"), ["k"], ["t"], ["v"], bucket)
    assert {(r.k, r.t): r.v for r in out.collect()} == naive_fill(data)


def test_previous_row_across_buckets(frame):
    data = [("a", t, t * 10) for t in (1, 2, 55, 120, 121)]
    out = windows.previous_row(frame(data, "k string, t int, v int"), "k", ["t"], ["v"], F.floor(F.col("t") / 50))
    assert rows(out, "t", "previous_v") == [(1, None), (120, 550), (121, 1200), (2, 10), (55, 20)]


def test_take_while(frame):
    data = [("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("c", 1, True)]
    df = frame(data, "k string, pos int, stop boolean")
    assert rows(windows.take_while(df, ["k"], ["pos"], F.col("stop")), "k", "pos") == [("a", 1), ("b", 1)]


def test_grid_and_cpi_fill(frame):
    cpi = frame([("eu", 2000, 1.0, 3.0), ("eu", 2002, 3.0, 3.0), ("uk", 2001, 5.0, 5.0)], "region string, year int, cpi double, most_recent_cpi double")
    got = rows(price_history.filled_cpi(cpi, 2003), "region", "year", "cpi")
    assert got == [
        ("eu", 2000, 1.0), ("eu", 2001, 1.0), ("eu", 2002, 3.0), ("eu", 2003, 3.0),
        ("uk", 2000, None), ("uk", 2001, 5.0), ("uk", 2002, 5.0), ("uk", 2003, 5.0),
    ]


def test_monthly_rates_carry_past_the_end(frame):
    fx = frame([("USD", "2020-01-05", 1.0), ("USD", "2020-01-20", 3.0), ("USD", "2020-03-01", 5.0)], "currency string, ts string, rate double")
    wanted = frame([("USD", m) for m in ("2019-12-01", "2020-01-01", "2020-02-01", "2020-04-01", "2020-05-01")] + [("CAD", "2020-04-01"), ("zl", "2020-01-01"), (None, "2020-01-01")], "currency string, month string")
    out = price_history.monthly_rates(fx.withColumn("ts", F.col("ts").cast("timestamp")), wanted.withColumn("month", F.col("month").cast("date")))
    got = {(r.currency, str(r.month)[:7]): r.fx_rate_CAD for r in out.collect()}
    assert got == {
        ("USD", "2019-12"): None, ("USD", "2020-01"): 2.0, ("USD", "2020-02"): 2.0, ("USD", "2020-04"): 5.0,
        ("USD", "2020-05"): 5.0, ("CAD", "2020-04"): 1.0, ("zl", "2020-01"): None,
    }


@pytest.mark.parametrize("bucket", ["day", "month"])
def test_asof_join(frame, bucket):
    random.seed(2)
    left = [(i, random.choice("ab"), f"2020-{random.randint(1, 12):02d}-{random.randint(1, 28):02d}") for i in range(100)]
    right = {(random.choice("ab"), f"2020-{random.randint(1, 12):02d}-{random.randint(1, 28):02d}"): i for i in range(30)}
    lf = frame(left, "id int, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    rf = frame([(k, t, v) for (k, t), v in right.items()], "k string, t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.id: r.v for r in joins.asof_join(lf, rf, ["k"], "t", "t", ["v"], bucket).collect()}
    for i, k, t in left:
        known = [(rt, v) for (rk, rt), v in right.items() if rk == k and rt <= t]
        assert got[i] == (max(known)[1] if known else None)


def test_one_to_one_fails_on_duplicates(frame):
    a, b = frame([("u", 1), ("w", 2)], "url string, x int"), frame([("u", 3), ("u", 4)], "url string, y int")
    assert joins.one_to_one(a, b.limit(1), ["url"]).count() == 1
    with pytest.raises(Exception, match="duplicate key u"):
        joins.one_to_one(a, b, ["url"]).collect()


def test_coordinates_do_not_fan_out(frame):
    ads = frame([(1, "Calgary, Canada"), (2, "Moon")], "i int, location string")
    places = frame([("Calgary, Canada", -114.0, 51.0), ("Calgary, Canada", -114.0, 51.0)], "location string, lon double, lat double")
    assert rows(joins.attach_coordinates(ads, places), "i", "lat") == [(1, 51.0), (2, None)]
    assert rows(joins.missing_coordinates(ads, places)) == [("Moon",)]


@pytest.mark.parametrize("km", [1.0, 300.0, 5000.0, 25000.0])
def test_distance_join_against_brute_force(frame, km):
    random.seed(int(km))
    spot = lambda: (random.uniform(-90, 90), random.uniform(-180, 180))
    near = lambda p: (max(-90.0, min(90.0, p[0] + random.uniform(-1e-2, 1e-2))), p[1])
    points = [(i, *spot()) for i in range(30)] + [(30, 89.9, 10.0), (31, -90.0, 0.0), (32, 0.0, 180.0), (33, 10.0, -180.0)]
    others = [(i, *spot()) for i in range(60)] + [(60 + i, *near(p[1:])) for i, p in enumerate(points)]
    p = frame(points, "p int, ref_lat double, ref_lon double")
    r = frame(others, "r int, lat double, lon double")
    from marketloom.functions.columns import haversine_km

    expected = rows(p.crossJoin(r).where(haversine_km("ref_lat", "ref_lon", "lat", "lon") <= km), "p", "r")
    assert rows(geo.distance_join(p, r, km), "p", "r") == expected


def test_distance_join_compares_places_once(frame, monkeypatch):
    """Rows of one place, more than an array holds, meet the others once and all come out, repeated ones too."""
    monkeypatch.setattr(geo, "ROWS_PER_PLACE", 7)
    places = [(50.0, 8.0), (50.5, 8.5), (-0.0, 180.0), (None, 1.0)]
    p = frame([(i, *places[i % 4]) for i in range(40)], "p int, ref_lat double, ref_lon double")
    r = frame([(i // 2, *places[i % 4]) for i in range(60)] + [(99, float("nan"), 8.0)], "r int, lat double, lon double")
    from marketloom.functions.columns import haversine_km

    expected = rows(p.crossJoin(r).where(haversine_km("ref_lat", "ref_lon", "lat", "lon") <= 100), "p", "r")
    assert rows(geo.distance_join(p, r, 100.0), "p", "r") == expected and len(expected) == 750
    near = geo._near_places(geo._by_place(p, "ref_lat", "ref_lon", "_p"), geo._by_place(r, "lat", "lon", "_r"), 100.0)
    assert near.select("_p_lat", "_r_lat").distinct().count() == 5 and near.count() <= 36


@pytest.mark.parametrize("lat, lon, km", [(51.0, -114.0, 800), (89.0, 0.0, 500), (0.0, 179.5, 300), (10.0, 10.0, 21000)])
def test_bounding_box_never_loses_rows(frame, lat, lon, km):
    random.seed(7)
    data = [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(3000)]
    data += [(max(-90.0, min(90.0, lat + random.uniform(-6, 6))), (lon + random.uniform(-9, 9) + 180) % 360 - 180) for _ in range(2000)]
    df = frame(data, "lat double, lon double")
    from marketloom.functions.columns import haversine_km

    expected = df.where(haversine_km(F.lit(lat), F.lit(lon), "lat", "lon") <= km).count()
    assert geo.within_distance(df, "lat", "lon", lat, lon, km).count() == expected


def hot_seconds(spark, n=20_000):
    """One key with an event every third minute or so over several years, hardly any of them with a value."""
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 211)
    return spark.range(n).select(F.lit("hot").alias("k"), at.alias("t"), F.when(F.col("id") % 997 == 5, F.col("id")).alias("v"), F.col("id").alias("i"))


@pytest.mark.parametrize("unit", ["second", "minute", "hour", "day", "month"])
def test_layered_carry_equals_one_window(spark, unit):
    df = hot_seconds(spark).unionByName(hot_seconds(spark, 50).withColumn("k", F.lit(None).cast("string")))
    levels = windows.time_levels("t", unit)
    want = windows.forward_fill(df, ["k"], ["t"], ["v"])
    got = windows.forward_fill(df, ["k"], ["t"], ["v"], levels)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    before = windows.previous_row(df, "k", ["t"], ["i"], levels).where("previous_i is distinct from nullif(i, 0) - 1")
    assert before.count() == 0


def test_layered_carry_with_null_times(frame):
    data = [("a", None, 7), ("a", "2024-01-01 00:00:00", None), ("a", "2025-05-01 00:00:00", None), ("b", "2024-01-01 00:00:00", None)]
    df = stamped(frame, data)
    out = windows.forward_fill(df, ["url"], ["ts"], ["v"], windows.time_levels("ts", "second"))
    assert rows(out, "url", "v") == [("a", 7), ("a", 7), ("a", 7), ("b", None)]


def test_no_window_gathers_the_buckets_of_a_key(spark):
    """Below the coarsest level each window is bound to one coarser bucket, so a hot key's summaries spread."""
    df = hot_seconds(spark)
    levels = windows.time_levels("t", "second")
    named = {f"l{i}": c for i, c in enumerate(levels)}
    summaries = df.withColumns(named).groupBy("k", *named).agg(F.max("v").alias("s"))
    per_window = [
        summaries.groupBy("k", "l1").count().agg(F.max("count")).first()[0],
        summaries.groupBy("k", "l1", "l2").count().groupBy("k", "l2").count().agg(F.max("count")).first()[0],
        summaries.select("k", "l2").distinct().count(),
    ]
    assert summaries.count() == 20_000 and max(per_window) <= 744
    plan = windows.carry_in(summaries, ["k"], list(named), ["s"])._jdf.queryExecution().optimizedPlan().toString()
    scopes = [line.split("], [", 1)[1] for line in plan.splitlines() if " Window [" in line or line.lstrip(" :+-").startswith("Window [")]
    bound = [x.split("#")[0] for x in scopes if "ASC" not in x.split("]")[0]]  # the others order by what follows
    assert len(scopes) == 3 and sorted(bound) == ["l1", "l2"]


def test_time_unit_gets_finer_for_a_hot_key(frame):
    data = [("hot", f"2024-01-01 {h:02d}:{m:02d}:00") for h in range(10) for m in range(60)] + [("cold", "2024-01-01 00:00:00")]
    df = frame(data, "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [windows.time_unit(df, ["k"], "t", n) for n in (600, 599, 59, 0)] == ["month", "hour", "minute", "second"]


def test_search_filters_reach_the_scan(spark, frame):
    from marketloom.plans.search import relevant_listings
    from marketloom.session import shared_folder

    columns = "ad_title string, url string, price double, currency string, last_repost_date string, predicted_price double, price_cad double, front_travel double, rear_travel double, frame_size_normalized string, category string, lat double, lon double"
    data = [("a", "u1", 10.0, "CAD", "d", 30.0, 10.0, 150.0, 140.0, "M", "Trail", 51.0, -114.0), ("b", "u2", 10.0, "CAD", "d", None, 10.0, 150.0, 140.0, "M", "Trail", 51.5, -114.0), ("c", "u3", 10.0, "CAD", "d", 90.0, 10.0, 150.0, 140.0, "M", "Trail", 10.0, 10.0)]
    path = shared_folder(spark, "scored")
    frame(data, columns).write.parquet(path)
    args = dict(price_limit_cad=100, min_front_travel=100, max_front_travel=160, min_rear_travel=100, max_rear_travel=150, frame_size="M", category="Trail", lon=-114.0, lat=51.0, distance_km_threshold=100)
    found = relevant_listings(spark.read.parquet(path), **args)
    assert [(r.url, r.predicted_price_diff, r.distance_km) for r in found.collect()] == [("u2", None, 55.6), ("u1", 20.0, 0.0)]
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = relevant_listings(spark.read.parquet(path), **args)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert all(text in pushed for text in ("LessThan(price_cad", "EqualTo(category,Trail)", "LessThanOrEqual(lat", "GreaterThanOrEqual(lon"))
    assert "TakeOrderedAndProject" in plan
