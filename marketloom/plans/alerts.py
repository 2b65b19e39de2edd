"""Saved alerts: every rule is evaluated in one pass over the listings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..operators import changes as ch
from ..operators import filters


CHUNK = 200
BAD_RULE = "Check alert search string definition"
BAD_CURRENCY = "Unknown currency"


@dataclass
class Alert:
    """A saved rule; `price_rule` defaults to any positive price."""

    uuid: str
    category_num: int
    rule: str
    last_checked: datetime
    price_rule: str | None = None
    name: str = ""


def load_rules(table: DataFrame) -> list[Alert]:
    """Rules are user settings, written by hand; they become predicates of plans over ``CHUNK`` rules each."""
    clock = F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_checked")  # the session's clock, not the driver's
    rows = table.select("uuid", "category_num", "search_string", "price_search_string", "alert_name", clock).orderBy("uuid").collect()
    return [
        Alert(r.uuid, r.category_num, r.search_string, datetime.fromisoformat(r.last_checked), r.price_search_string, r.alert_name or "") for r in rows
    ]


def _in_rule(df: DataFrame, alert: Alert, rule: str) -> Column:
    text = filters.rule_predicate(df, rule)
    return F.coalesce(text, F.lit(False))


def _moment(alert: Alert) -> Column:
    return F.lit(alert.last_checked.isoformat(sep=" ")).cast("timestamp")


def evaluate_alerts(
    listings: DataFrame,
    changes: DataFrame,
    alerts: list[Alert],
    predict: Callable[[DataFrame], DataFrame],
    columns: list[str] | None = None,
) -> DataFrame:
    """Matching listings per alert, plus one error row per rule that is not allowed or does not resolve.

    The listings are read once per ``CHUNK`` rules: each row gets the list of alerts it meets, then
    one row per alert. `predict` adds `pred_price`. Price drops fan out, one row
    per drop, as in the change log. A rule that cannot handle a row's values does not hit that
    row; a hit whose currency is unknown becomes an error row with its url, since its price cannot be judged.
    """
    with filters.lenient(listings.sparkSession):
        parts = [_evaluate(listings, changes, alerts[i : i + CHUNK], predict, columns or fv.ALERT_COLUMNS) for i in range(0, len(alerts), CHUNK)]
    parts = [part for found in parts for part in found]
    if not parts:
        return listings.sparkSession.createDataFrame([], "alert_uuid string, error string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _evaluate(listings: DataFrame, changes: DataFrame, alerts: list[Alert], predict: Callable[[DataFrame], DataFrame], wanted: list[str]) -> list[DataFrame]:
    spark = listings.sparkSession
    errors, hits = [], []
    for alert in alerts:
        try:
            condition = _in_rule(listings, alert, alert.rule)
        except filters.RuleError:
            errors.append((alert.uuid, BAD_RULE))
            continue
        if alert.category_num not in (None, -1):
            condition = condition & (F.col("category_num") == alert.category_num)
        condition = condition & (F.col("datetime_scraped") > _moment(alert))
        hits.append((alert, F.when(condition, F.lit(alert.uuid))))
    parts = []
    if hits:
        tagged = listings.withColumn("_alerts", F.array_compact(F.array(*[h for _, h in hits])))
        matched = tagged.where(F.size("_alerts") > 0).withColumn("alert_uuid", F.explode("_alerts")).drop("_alerts")
        starts = F.create_map(*[F.lit(x) for a, _ in hits for x in (a.uuid, a.last_checked.isoformat(sep=" "))])
        since = F.from_utc_timestamp(F.try_element_at(starts, F.col("alert_uuid")).cast("timestamp"), ch.SITE_ZONE).cast("date")
        drops = ch.dated_price_drops(changes).withColumnRenamed("url", "_url")
        joined = matched.withColumn("_since", since).join(drops, (F.col("url") == F.col("_url")) & (F.col("drop_day") >= F.col("_since")), "left")
        priced_in = C.fixed_rate_cad("price", "currency")
        strange = F.col("price").isNotNull() & priced_in.isNull()
        scored = predict(joined.withColumns({"price": priced_in, "_strange": strange}))
        scored = scored.withColumn("pred_price_diff", F.col("pred_price") - F.col("price"))
        priced = []
        for alert, _ in hits:
            try:
                priced.append(F.when(_in_rule(scored, alert, alert.price_rule or "price > 0"), F.lit(alert.uuid)))
            except filters.RuleError:
                errors.append((alert.uuid, BAD_RULE))
        keep = F.array_contains(F.array(*priced), F.col("alert_uuid")) if priced else F.lit(False)
        keep = F.coalesce(keep, F.lit(False))
        parts.append(filters.alert_projection(scored.where(keep), ["alert_uuid", *wanted]).withColumn("error", F.lit("")))
        parts.append(scored.where("_strange").select("alert_uuid", "url", F.lit(BAD_CURRENCY).alias("error")).distinct())
    if errors:
        parts.append(spark.createDataFrame(errors, "alert_uuid string, error string"))
    return parts


def sort_for_mail(df: DataFrame) -> DataFrame:
    """Largest price drop first, then cheapest."""
    order = [F.desc_nulls_last(F.col("price_change").try_cast("double")), F.asc_nulls_last(F.col("price").try_cast("double"))]
    return df.orderBy("alert_uuid", *order)
