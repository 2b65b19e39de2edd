import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marketloom.operators import changes as ch
from marketloom.plans import alerts as al
from marketloom.plans.refresh import refresh

from .conftest import rows

COLUMNS = "url string, category string, ad_title string, description string, price double, currency string"


def ads(frame, data):
    """url, price, description with the other columns filled."""
    full = [(u, "Trail", "t", d, p, "CAD") for u, p, d in data]
    return frame(full, COLUMNS).withColumn("last_repost_date", F.lit("2024-02-03 05:00:00").cast("timestamp"))


def test_changed_rows_and_log(frame):
    old = ads(frame, [("same", 1.0, "d"), ("space", 1.0, "d"), ("set", None, "d"), ("unset", 5.0, "d"), ("nulls", None, None), ("two", 1.0, "d")])
    new = ads(frame, [("same", 1.0, "d"), ("space", 1.0, " d "), ("set", 2.0, "d"), ("unset", None, "d"), ("nulls", None, None), ("two", 2.0, "e"), ("new", 1.0, "d")])
    assert rows(ch.changed_rows(old, new), "url") == [("set",), ("space",), ("two",), ("unset",)]
    log = ch.changelog(old, new)
    assert rows(log, "url", "field", "old_value", "new_value") == [
        ("set", "price", None, "2.0"), ("two", "description", "d", "e"), ("two", "price", "1.0", "2.0"), ("unset", "price", "5.0", None),
    ]
    assert {r.update_date for r in log.collect()} == {"2024-02-03"}
    assert rows(ch.membership_differences(old, new)) == [("new", "updated")]


def test_keyed_table_operations(frame):
    store = frame([("a", 1, "x"), ("b", 2, "y")], "url string, n int, s string")
    incoming = frame([("b", 9), ("c", 7), ("c", 8)], "url string, n int")
    assert rows(ch.insert_if_absent(store, incoming, "url", ["n"])) == [("a", 1, "x"), ("b", 2, "y"), ("c", 7, None)]
    updates = frame([("a", None), ("z", 5)], "url string, n int")
    assert rows(ch.keyed_update(store, updates, "url", ["n"])) == [("a", None, "x"), ("b", 2, "y")]
    assert rows(ch.keyed_delete(store, frame([("a",)], "url string"))) == [("b", 2, "y")]
    with pytest.raises(ValueError):
        ch.keyed_update(store, updates, "url", ["s"])
    with pytest.raises(ValueError):
        ch.keyed_delete(store, frame([("a",)], "other string"))


def test_recent_rule_is_48_hours_in_utc_minus_7(frame):
    data = [("in", "2024-01-08 05:30:00", "not boosted"), ("edge", "2024-01-08 05:00:00", "not boosted"), ("old", "2024-01-07 05:00:00", "not boosted"), ("up", "2020-01-01 00:00:00", "boosted"), ("null", None, "not boosted")]
    df = frame(data, "url string, last_repost_date string, status string").withColumn("last_repost_date", F.col("last_repost_date").cast("timestamp"))
    anchored = df.withColumn("last_scrape", F.lit("2024-01-10 12:00:00").cast("timestamp"))
    assert rows(ch.recent_rows(anchored), "url") == [("in",), ("up",)]


def test_anchor_defaults_and_full_refresh(frame):
    stored = frame([(1, "2024-01-01 00:00:00")], "category_num int, datetime_scraped string").withColumn("datetime_scraped", F.col("datetime_scraped").cast("timestamp"))
    cats = frame([(1,), (2,)], "category_num int")
    anchors = ch.last_scrape(stored)
    got = {r.category_num: str(r.last_scrape)[:4] for r in ch.with_anchor(cats, anchors).collect()}
    assert got == {1: "2024", 2: "1900"}
    assert {str(r.last_scrape)[:4] for r in ch.with_anchor(cats, anchors, full_refresh=True).collect()} == {"1900"}


def test_routing_of_known_sold(frame):
    df = frame([("a", "Sold"), ("b", "SOLD!"), ("c", "Still For Sale"), ("d", None)], "url string, still_for_sale string")
    store = frame([("b",)], "url string")
    assert rows(ch.route(df, store), "url", "route") == [("a", "sold"), ("b", "known_sold"), ("c", "active"), ("d", "active")]
    assert ("b", "active") in rows(ch.route(df, store, strict=False), "url", "route")


def test_price_drops_compare_numbers(frame):
    log = frame([("a", "price", "$1,000", "900", "2024-01-02"), ("b", "price", "900", "1000", "2024-01-02"), ("c", "price", "10", "9", "2023-12-31"), ("d", "ad_title", "2", "1", "2024-01-02")], "url string, field string, old_value string, new_value string, update_date string")
    got = ch.price_drops(log, F.lit("2024-01-01 22:00:00").cast("timestamp"))
    assert rows(got) == [("a", 100.0)]


STORE = """url string, category string, category_num int, ad_title string, description string, price double, currency string,
still_for_sale string, view_count string, watch_count string, last_repost_date string, datetime_scraped string"""


def listing(url, price=100.0, status="Still For Sale", day="2024-01-09", scraped="2024-01-10", category_num=1, currency="CAD"):
    return (url, "Trail Bikes", category_num, "t", "d", price, currency, status, "5", "6", f"{day} 12:00:00", f"{scraped} 00:00:00")


def store(frame, data):
    stamp = {c: F.col(c).cast("timestamp") for c in ("last_repost_date", "datetime_scraped")}
    return frame(data, STORE).withColumns(stamp)


@pytest.fixture
def crawl(frame):
    active = store(frame, [listing("keep"), listing("edit"), listing("gone"), listing("gone-sold"), listing("was-sold"), listing("old")])
    sold = store(frame, [listing("was-sold", status="Sold")])
    listed = frame([(u, 1, s, 1, i) for i, (u, s) in enumerate([("keep", "not boosted"), ("edit", "not boosted"), ("new", "not boosted"), ("sold-listed", "not boosted"), ("was-sold", "not boosted"), ("old", "not boosted"), ("old-new", "not boosted"), ("lift", "boosted")])], "url string, category_num int, status string, page_no int, pos int")
    parsed = store(frame, [
        listing("keep", scraped="2024-01-12"), listing("edit", 90.0, scraped="2024-01-12"), listing("new", scraped="2024-01-12"),
        listing("sold-listed", status="Sold", scraped="2024-01-12"), listing("was-sold", status="Sold", scraped="2024-01-12"),
        listing("old", 1.0, day="2023-01-01", scraped="2024-01-12"), listing("old-new", day="2023-01-01", scraped="2024-01-12"),
        listing("lift", day="2023-01-01", scraped="2024-01-12"), listing("gone-sold", status="Sold", scraped="2024-01-12"),
    ])
    return active, sold, listed, parsed


@pytest.mark.parametrize("parts", [1, 5])
def test_refresh(crawl, parts):
    out = refresh(*[df.repartition(parts) for df in crawl])
    # "old" is stale, so its new price is not seen; "old-new" was never stored, so it is caught up.
    assert rows(out.active, "url", "price") == [("edit", 90.0), ("keep", 100.0), ("lift", 100.0), ("new", 100.0), ("old", 100.0), ("old-new", 100.0)]
    assert rows(out.sold, "url") == [("gone-sold",), ("sold-listed",), ("was-sold",)]
    assert rows(out.changes, "url", "field", "new_value") == [("edit", "price", "90.0")]
    assert rows(out.removed, "url") == [("gone",), ("gone-sold",), ("was-sold",)]
    assert rows(out.new_active, "url") == [("lift",), ("new",), ("old-new",)]


def test_refresh_without_recent_rows_still_captures_sold(crawl):
    active, sold, listed, parsed = crawl
    out = refresh(active, sold, listed.where("url = 'old'"), parsed.where("url in ('old', 'gone-sold')"))
    assert rows(out.new_sold, "url") == [("gone-sold",)]


def test_alerts_keep_bad_rules_as_error_rows(frame):
    base = store(frame, [listing("a", 500.0, currency="USD"), listing("b", 5000.0), listing("c", 50.0, currency="zl"), listing("d", 50.0, scraped="2023-01-01")])
    base = base.withColumns({"location": F.lit("x"), "original_post_date": F.lit("2024-01-01")})
    log = frame([("a", "price", "900", "500", "2024-01-09"), ("a", "price", "950", "900", "2024-01-08"), ("b", "price", "9", "1", "2023-01-09")], "url string, field string, old_value string, new_value string, update_date string")
    rules = [
        al.Alert("ok", 1, "price < 9000", datetime(2024, 1, 5), "price < 4000"),
        al.Alert("bad", 1, "pricey < 9000", datetime(2024, 1, 5)),
        al.Alert("syntax", 1, "price <", datetime(2024, 1, 5)),
        al.Alert("other", 7, "price < 9000", datetime(2024, 1, 5)),
        al.Alert("badprice", 1, "price < 9000", datetime(2024, 1, 5), "prise > 1"),
        al.Alert("jvm", 1, "reflect('java.lang.System', 'getProperty', 'user.name') = 'x'", datetime(2024, 1, 5)),
        al.Alert("query", 1, "price in (select 1)", datetime(2024, 1, 5)),
        al.Alert("fails", 1, "price < 9000", datetime(2024, 1, 5), "cast(ad_title as int) > 1"),
    ]
    out = al.evaluate_alerts(base, log, rules, lambda df: df.withColumn("pred_price", F.lit(1000.0)))
    good = out.where("error = ''")
    assert rows(good, "alert_uuid", "url", "price", "price_change", "pred_price_diff") == [
        ("ok", "a", "625.0", "400.0", "375.0"), ("ok", "a", "625.0", "50.0", "375.0"),
    ]
    assert rows(out.where("error <> ''"), "alert_uuid", "url", "error") == [
        ("bad", None, al.BAD_RULE), ("badprice", None, al.BAD_RULE), ("badprice", "c", al.BAD_CURRENCY), ("fails", "c", al.BAD_CURRENCY),
        ("jvm", None, al.BAD_RULE), ("ok", "c", al.BAD_CURRENCY), ("query", None, al.BAD_RULE), ("syntax", None, al.BAD_RULE),
    ]
    assert [r.price_change for r in al.sort_for_mail(good).collect()] == ["400.0", "50.0"]


def test_more_rules_than_one_plan_holds(frame, monkeypatch):
    monkeypatch.setattr(al, "CHUNK", 2)
    base = store(frame, [listing("a", 500.0), listing("b", 5000.0)]).withColumns({"location": F.lit("x"), "original_post_date": F.lit("2024-01-01")})
    log = frame([], "url string, field string, old_value string, new_value string, update_date string")
    rules = [al.Alert(f"r{i}", 1, f"price < {i * 1000}", datetime(2024, 1, 5)) for i in range(5)]
    out = al.evaluate_alerts(base, log, rules, lambda df: df.withColumn("pred_price", F.lit(1000.0)))
    assert rows(out, "alert_uuid", "url") == [(f"r{i}", "a") for i in range(1, 5)]


def test_sold_rows_need_what_their_category_fills_whoever_comes_along(frame):
    columns = "url string, category_num int, still_for_sale string, view_count string, front_travel string, datetime_scraped string"
    stored = frame([("s", 1, "Sold", "5", None, "2023-01-01"), ("t", 2, "Sold", "5", "150", "2023-01-01"), ("u", 2, None, None, None, "2023-01-01")], columns)
    fields = ch.category_fields(stored)
    batch = [("a", 1, "Sold", "5", None), ("b", 1, "Sold", None, None), ("c", 2, "Sold", "5", "150"), ("d", 2, "Sold", "5", None), ("e", 1, "For Sale", "7", None), ("f", 3, "Sold", "5", None), ("g", 3, "Sold", "5", "1"), ("h", None, "Sold", "5", "1")]
    capture = lambda data: [r[0] for r in rows(ch.sold_capture(frame([(*r, "2024-01-01") for r in data], columns), stored, ["view_count"], fields=fields), "url")]
    assert capture(batch) == ["a", "c", "g"]
    assert sum((capture([r]) for r in batch), []) == ["a", "c", "g"]


def test_refresh_keeps_sold_rows_whoever_comes_along(crawl, frame):
    active, sold, listed, parsed = crawl
    bare = parsed.where("url = 'gone-sold'").withColumn("description", F.lit(None).cast("string"))
    alone = refresh(active, sold, listed, bare)
    beside = refresh(active, sold, listed, bare.unionByName(parsed.where("url <> 'gone-sold'")))
    assert rows(alone.new_sold, "url") == [] and rows(beside.new_sold, "url") == [("sold-listed",)]
    plain = [df.withColumn("description", F.lit(None).cast("string")) for df in (active, sold)]
    assert rows(refresh(*plain, listed, bare).new_sold, "url") == [("gone-sold",)]


def test_refresh_reads_each_input_once(crawl, tmp_path):
    inputs = []
    for name, df in zip(("active", "sold", "listed", "parsed"), crawl):
        df.write.parquet(f"{tmp_path}/{name}")
        inputs.append(df.sparkSession.read.parquet(f"{tmp_path}/{name}"))
    from marketloom.plans.refresh import merged

    plan = merged(*inputs)._jdf.queryExecution().executedPlan().toString()
    assert all(len(re.findall(rf"InMemoryFileIndex[^\n]*/{name}\b", plan)) == 1 for name in ("active", "sold", "listed", "parsed"))
    assert plan.count("Exchange hashpartitioning(url") == 1 and "Join" not in plan
    out = refresh(*inputs)
    for part in (out.active, out.sold, out.changes, out.new_active, out.new_sold, out.removed):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and not re.search(r"InMemoryFileIndex[^\n]*/(active|listed|parsed)\b", plan)


def test_refresh_with_repeated_rows_prefix_and_empty_inputs(crawl):
    active, sold, listed, parsed = crawl
    out = refresh(active.unionByName(active), sold, listed.unionByName(listed), parsed.unionByName(parsed))
    assert rows(out.new_active, "url") == [("lift",), ("new",), ("old-new",)]
    assert rows(out.new_sold, "url") == [("gone-sold",), ("sold-listed",)]
    assert rows(out.changes, "url", "field", "new_value") == [("edit", "price", "90.0")]
    assert rows(out.active.where("url = 'edit'"), "price") == [(90.0,), (90.0,)]
    short = refresh(active, sold, listed, parsed, prefix=True)
    # The prefix ends at "old"; listed pages behind it that were never stored are still caught up.
    assert rows(short.new_active, "url") == [("lift",), ("new",), ("old-new",)]
    empty = [df.limit(0) for df in crawl]
    first = refresh(empty[0], empty[1], listed, parsed)
    assert rows(first.removed, "url") == [] and rows(first.active, "url") == [("edit",), ("keep",), ("lift",), ("new",), ("old",), ("old-new",)]
    assert rows(refresh(*empty).active, "url") == []


def test_repeated_keys_give_one_row(frame):
    stored = frame([("a", 1.0)], "url string, price double")
    updates = frame([("a", 2.0, 1), ("a", 3.0, 2), ("a", 4.0, 1), ("b", 5.0, 1), ("b", 6.0, 2)], "url string, price double, seq int")
    assert rows(ch.keyed_update(stored, updates, "url", ["price"], ["seq"])) == [("a", 3.0)]
    assert rows(ch.keyed_update(stored, updates, "url", ["price"])) == [("a", 2.0)]
    assert rows(ch.insert_if_absent(stored, updates.drop("seq"), "url")) == [("a", 1.0), ("b", 5.0)]


def test_dates_as_pages_write_them(frame):
    old = frame([("a", "T", 1.0, "Sep-21-2021 11:46:21")], "url string, category string, price double, last_repost_date string")
    new = old.withColumn("price", F.lit(2.0))
    assert rows(ch.changelog(old, new, ["price"]), "url", "new_value", "update_date") == [("a", "2.0", "2021-09-21")]
    ads = frame([("a", "Sep-21-2021 11:46:21", "x"), ("b", "Sep-01-2021 1:06:56", "x"), ("c", "no date", "x")], "url string, last_repost_date string, status string")
    ads = ads.withColumn("last_scrape", F.lit("2021-09-21 00:00:00").cast("timestamp"))
    assert rows(ads.where(ch.is_recent()), "url") == [("a",)]
