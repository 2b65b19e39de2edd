"""M group: features, models, scoring, price history and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import fixed_values as fv
from marketloom.operators import aggregates, features, joins, matching, models, outliers, text_features
from marketloom.plans import price_history, scored, search

from .aggregates import SPLITS, predicted
from .inputs import Registry, Tables, with_inputs
from .joins import CPI, REGIONS, perturbed_titles, spec_rows, values_sql, yearly_cpi
from .scalars import SPOT, spot_rates

q = Registry()


@q("m01_split", with_inputs(SPLITS + "select order_key, split from split_rows"))
def m01(t: Tables):
    return t.listings().select("order_key", features.split_column("order_key").alias("split"))


@q("m02_listing_features", with_inputs("""select order_key, coalesce(date_diff('day', make_date(cast(nullif(regexp_extract(ad_title || ' ' || description, '((?:19|20)\\d{2})', 1), '') as int), 1, 1), cast(original_post_date as date)), -1000) as age_at_post,
strftime(original_post_date, '%B') as post_month, nullif(regexp_extract(location, ', ([A-Za-z\\s]+)', 1), '') as country, 0 as covid_flag,
regexp_replace(ad_title, '((?:19|20)\\d{2})', '', 'g') as title_text, regexp_replace(description, '((?:19|20)\\d{2})', '', 'g') as description_text, price as target from listings"""))
def m02(t: Tables):
    return features.listing_features(t.listings(), "price").select(
        "order_key", "age_at_post", "post_month", "country", "covid_flag", "title_text", "description_text", "target"
    )


@q("m03_category_index", with_inputs("select location, row_number() over (order by count(*) desc, location) - 1 as category_index from listings group by 1"))
def m03(t: Tables):
    return features.feature_index(t.listings(), "location")


@q("m03_one_hot", with_inputs("select order_key, coalesce(rank, (select count(distinct frame_size) from listings)) as slot from listings l left join (select frame_size, row_number() over (order by count(*) desc, frame_size) - 1 as rank from listings where frame_size is not null group by 1) r using (frame_size)"))
def m03_one_hot(t: Tables):
    from pyspark.ml.functions import vector_to_array

    rows = t.listings().select("order_key", "frame_size")
    model = models.fit(features.one_hot_stages(["frame_size"]), rows)
    slots = F.array_position(vector_to_array("frame_size_onehot"), F.lit(1.0)) - 1
    return model.transform(rows).select("order_key", slots.alias("slot"))


TOKENS = r"[a-zA-Z0-9$&+,:;=?@#|<>^%!]+|[0-9$&+,.:;=?@#|<>^%!]+"


@q("m04_tfidf", f"""with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) as term from documents),
counts as (select doc_id, term, count(*) as tf from tok group by 1, 2),
vocab as (select term, count(*) as df, sum(tf) as total from counts group by 1 order by total desc, term limit 2000),
w as (select doc_id, c.term, tf * (ln((select count(*) from documents) + 1) - ln(df + 1) + 1) as w from counts c join vocab using (term)),
n as (select doc_id, sqrt(sum(w * w)) as norm from w group by 1)
select doc_id, term, round(w / norm, 6) as weight from w join n using (doc_id)""")
def m04(t: Tables):
    out = features.tfidf(t.documents.select("doc_id", "text"), "doc_id", "text", 2000)
    return out.withColumn("weight", F.round("weight", 6))


SPLIT_DOCS = "cast(('0x' || substr(md5('42|' || cast(doc_id as string)), 1, 8)) as bigint) % 100"


@q("m04_text_features", f"""with words as (select doc_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) as a, generate_subscripts(regexp_extract_all(lower(text), '{TOKENS}'), 1) as i from documents),
runs as (select *, lead(a, 1) over w as b, lead(a, 2) over w as c, lead(a, 3) over w as d, lead(a, 4) over w as e from words window w as (partition by doc_id order by i)),
grams as (select doc_id, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c, a || ' ' || b || ' ' || c || ' ' || d, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e]) as term from runs),
counts as (select doc_id, {SPLIT_DOCS} < 70 as train, term, count(*) as tf from grams where term is not null group by all),
vocab as (select term, count(*) as df, sum(tf) as total from counts where train group by 1 order by total desc, term limit 3000),
w as (select doc_id, c.term, tf * (ln(((select count(*) from documents where {SPLIT_DOCS} < 70) + 1) / (df + 1)) + 1) as w from counts c join vocab using (term) where not train),
n as (select doc_id, sqrt(sum(w * w)) as norm from w group by 1)
select doc_id, term, round(w / norm, 6) as weight from w join n using (doc_id)""")
def m04_text_features(t: Tables):
    """n-grams to five words learned on the train split, applied to the other documents."""
    rows = t.documents.select("doc_id", "text", (features.split_column("doc_id") == "train").alias("train"))
    model = text_features.TextTerms(inputCol="text", outputCol="vector", nMin=1, nMax=5, maxFeatures=3000).fit(rows.where("train"))
    out = model.transform(rows.where("not train"))
    return text_features.term_weights(out, "doc_id", "vector", text_features.vocabulary(model)).withColumn("weight", F.round("weight", 6))


@q("m05_target_encoding", with_inputs(", o as (select avg(price) as m, var_pop(price) as v from listings), s as (select category, count(price) as n, avg(price) as cm, var_pop(price) as w from listings group by 1) select category, n, round(v * n / (v * n + w) * cm + (1 - v * n / (v * n + w)) * m, 4) as encoding from s, o"))
def m05(t: Tables):
    return features.target_encoding(t.listings(), "category", "price").withColumn("encoding", F.round("encoding", 4))


@q("m06_median_imputation", with_inputs(", n as (select order_key, cast(watch_count as double) as watch_count, case when frame_size is null then null else price end as price from listings) select order_key, coalesce(watch_count, (select median(watch_count) from n)) as watch_count, coalesce(price, (select median(price) from n)) as price from n"))
def m06(t: Tables):
    rows = t.listings().select("order_key", F.col("watch_count").cast("double").alias("watch_count"), F.when(F.col("frame_size").isNotNull(), F.col("price")).alias("price"))
    return features.impute(rows, features.fit_medians(rows, ["watch_count", "price"]))


@q("m07_max_abs", with_inputs("select order_key, lat / max(abs(lat)) over () as lat, lon / max(abs(lon)) over () as lon from listings"))
def m07(t: Tables):
    return features.max_abs_scale(t.listings().select("order_key", "lat", "lon"), ["lat", "lon"])


@q("m08_mean_baseline", with_inputs(SPLITS + ", m as (select avg(price) as m from split_rows where split = 'train') select split, round(avg(abs(price - m) / abs(price)), 6) as mape, round(sqrt(avg((price - m) * (price - m))), 4) as rmse, count(*) as n_rows from split_rows, m group by 1"))
def m08(t: Tables):
    rows = models.mean_baseline(t.listings().withColumn("split", features.split_column("order_key")), "price")
    out = aggregates.error_metrics(rows, "price", "pred", ["split"])
    return out.select("split", F.round("mape", 6).alias("mape"), F.round("rmse", 4).alias("rmse"), "n_rows")


def training_rows(t: Tables):
    """Line items with their part; the target is the extended price."""
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = t.lineitem.join(t.part, F.expr("l_partkey = p_partkey")).withColumn("line_key", key)
    return rows.select(
        "line_key", "l_quantity", "l_discount", "l_tax", F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
        "l_returnflag", "p_brand", "l_shipdate", F.col("l_extendedprice").alias("target"),
        features.split_column("line_key").alias("split"),
    )


NUMBERS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def _stages(estimator):
    return [*features.one_hot_stages(["l_returnflag"]), *features.assemble_stages([*NUMBERS, "l_returnflag_onehot"]), estimator]


def _train(rows):
    return rows.where("split = 'train'")


def _metrics(df):
    out = aggregates.error_metrics(df, "target", "pred", ["split"])
    return out.select("split", F.round("mape", 6).alias("mape"), F.round("rmse", 4).alias("rmse"), "n_rows")


@q("m09_robust_linear")
def m09(t: Tables):
    rows = training_rows(t)
    return _metrics(models.fit(_stages(models.robust_linear()), _train(rows)).transform(rows))


@q("m10_boosted_trees")
def m10(t: Tables):
    rows = training_rows(t)
    return _metrics(models.fit(_stages(models.boosted_trees()), _train(rows)).transform(rows))


@q("m11_grid_search")
def m11(t: Tables):
    from pyspark.ml import Pipeline
    from pyspark.ml.tuning import ParamGridBuilder

    rows = training_rows(t)
    linear = models.robust_linear()
    grid = ParamGridBuilder().addGrid(linear.regParam, [0.0, 0.1]).build()
    pipeline = Pipeline(stages=_stages(linear))
    results, _ = models.grid_search(pipeline, grid, _train(rows), rows.where("split = 'valid'"))
    return t.spark.createDataFrame([(float(s["regParam"]), float(rmse)) for s, rmse in results], "reg_param double, rmse double")


@q("m12_outlier_scores")
def m12(t: Tables):
    rows = training_rows(t)
    out = outliers.outlier_scores(rows, "line_key", [*NUMBERS, "target"], trees=1000, samples=256)
    return out.select("line_key", F.round("outlier_score", 6).alias("outlier_score"), "outlier_flag")


@q("m13_batch_scoring")
def m13(t: Tables):
    rows = training_rows(t)
    model = models.fit(_stages(models.robust_linear()), _train(rows))
    return models.score_batch(model, rows).select("line_key", F.round("pred", 4).alias("pred"))


BIKES = """lower(category) like '%bike%' and not regexp_matches(lower(category), 'parts|frames|bags|racks|stands|rims|mx')"""
SCORED = SPOT + f""", sizes as (select * from {values_sql(fv.FRAME_SIZES, 'frame', 'size')}),
near_places as (select location, min(lon) as lon, min(lat) as lat from places group by 1),
base_scored as (select l.* exclude (lat, lon), lat * 100 + 5000 as predicted_price_cad, coalesce(try_cast(nullif(regexp_extract(front_travel, '\\d*\\.?\\d+'), '') as double), 0) as front,
  coalesce(try_cast(nullif(regexp_extract(rear_travel, '\\d*\\.?\\d+'), '') as double), 0) as rear from listings l where {BIKES} and currency is distinct from 'zl'),
scored as (select b.*, p.lon, p.lat, case when b.currency = 'CAD' then price else price * rate_to_cad end as price_cad,
  case when b.currency = 'CAD' then predicted_price_cad else predicted_price_cad / rate_to_cad end as predicted_price, z.size as frame_size_normalized
  from base_scored b left join spot s on b.currency = s.currency left join near_places p on p.location = b.location left join sizes z on z.frame = trim(b.frame_size))
"""


def scored_table(t: Tables):
    predict = lambda df: df.withColumn("predicted_price_cad", F.col("lat") * 100 + 5000).drop("lat", "lon")
    return scored.scored_listings(t.listings(), spot_rates(t), t.places(), predict, "model-1")


@q("m14_scored_listings", with_inputs(SCORED + "select order_key, round(price_cad, 4) as price_cad, round(predicted_price, 4) as predicted_price, round(predicted_price - price, 4) as predicted_price_diff, 'model-1' as model_uuid, trim(material) as material, lon, lat, frame_size_normalized, front as front_travel, rear as rear_travel from scored"))
def m14(t: Tables):
    rounded = [F.round(c, 4).alias(c) for c in ("price_cad", "predicted_price", "predicted_price_diff")]
    rest = ("model_uuid", "material", "lon", "lat", "frame_size_normalized", "front_travel", "rear_travel")
    return scored_table(t).select("order_key", *rounded, *rest)


@q("m15_spec_augmentation")
def m15(t: Tables):
    catalogue = matching.spec_catalogue(spec_rows(t).drop("p_partkey"))
    titles = perturbed_titles(t)
    out = matching.augment_with_specs(titles, catalogue.withColumn("manufacturer", F.lower("manufacturer")), maker_threshold=70, model_threshold=70)
    return out.select("p_partkey", "fuzzy_match", "year_manufacturer_model", "msrp_cleaned", "weight_summary", "front_travel_summary", "rear_travel_summary")


def exact_price_model(rows, inputs):
    """A fitted linear model of a target without noise: it recovers the weights, so SQL can state its predictions."""
    stages = [*features.assemble_stages(inputs), models.least_squares()]
    return models.fit(stages, rows)


@q("m16_age_sweep", with_inputs("select order_key, cast(a.a as int) as age_at_post, round(price * 1.5::double - a.a * 2.5::double + 100, 2) as pred from listings, range(0, 3000, 100) a(a)"))
def m16(t: Tables):
    age = F.datediff("datetime_scraped", "original_post_date") + F.col("category_num") * 10
    rows = t.listings().select("order_key", "price", age.alias("age_at_post"))
    model = exact_price_model(rows.withColumn("target", F.expr("price * 1.5 - age_at_post * 2.5 + 100")), ["price", "age_at_post"])
    swept = models.sweep(rows, "age_at_post", models.age_grid(), model)
    return swept.select("order_key", "age_at_post", F.round("pred", 2).alias("pred"))


@q("m16_date_sweep", with_inputs("select order_key, cast(y.y as string) || '-01-01' as post_date from listings, range(2010, 2030) y(y) union all select order_key, '2022-' || lpad(cast(m.m as string), 2, '0') || '-01' from listings, range(1, 13) m(m)"))
def m16_dates(t: Tables):
    rows = t.listings().select("order_key", F.col("original_post_date").cast("date").alias("post_date"))
    both = models.sweep(rows, "post_date", models.january_grid()).unionByName(models.sweep(rows, "post_date", models.month_grid()))
    return both.withColumn("post_date", F.col("post_date").cast("string"))


@q("m17_partial_dependence_exact", with_inputs(""", e as (select quantile_cont(price, 0.05) as p0, quantile_cont(price, 0.95) as p1,
quantile_cont(category_num::double, 0.05) as c0, quantile_cont(category_num::double, 0.95) as c1 from listings)
select round(p0 + (p1 - p0) * i.i / 9, 4) as price, round(c0 + (c1 - c0) * j.j / 9, 4) as category_num,
round(1.5::double * (p0 + (p1 - p0) * i.i / 9) - 25 * (c0 + (c1 - c0) * j.j / 9) + m.lat * 2, 2) as mean_pred
from e, range(10) i(i), range(10) j(j), (select avg(lat) as lat from listings) m"""))
def m17_exact(t: Tables):
    rows = t.listings().select("order_key", "price", F.col("category_num").cast("double").alias("category_num"), "lat")
    model = exact_price_model(rows.withColumn("target", F.expr("price * 1.5 - category_num * 25 + lat * 2")), ["price", "category_num", "lat"])
    out = models.partial_dependence(rows, model, ["price", "category_num"], "order_key", sample=None)
    return out.select(F.round("price", 4).alias("price"), F.round("category_num", 4).alias("category_num"), F.round("mean_pred", 2).alias("mean_pred"))


@q("m11_ridge_grid", with_inputs(SPLITS + """, k as (select unnest([0.0, 1.0, 100.0, 10000.0])::double as penalty),
f as (select penalty, covar_pop(price, lat) / (var_pop(lat) + penalty) as w, avg(price) as my, avg(lat) as mx from split_rows, k where split = 'train' group by penalty)
select penalty, round(w, 6) as weight, (select round(sqrt(avg(power(price - (my + w * (lat - mx)), 2))), 4) from split_rows where split = 'valid') as rmse from f"""))
def m11_ridge(t: Tables):
    rows = t.listings().select("price", "lat", features.split_column("order_key").alias("split"))
    rows = models.fit(features.assemble_stages(["lat"], scale=False), rows).transform(rows)
    results, weights = models.ridge_grid(rows, [0.0, 1.0, 100.0, 10_000.0], target="price")
    found = [(p, float(round(weights[p][1], 6)), rmse if rmse is None else round(rmse, 4)) for p, rmse in results]
    return t.spark.createDataFrame(found, "penalty double, weight double, rmse double")


@q("m17_partial_dependence")
def m17(t: Tables):
    rows = training_rows(t)
    model = models.fit(_stages(models.robust_linear()), _train(rows))
    out = models.partial_dependence(rows, model, ["l_quantity", "p_size"], "line_key")
    return out.withColumn("mean_pred", F.round("mean_pred", 4))


@q("m18_inspection_set", with_inputs(SPLITS + ", m as (select avg(price) as m from split_rows where split = 'train') select order_key, split, price, round(m, 4) as pred, round(price - m, 4) as resid, ad_title from split_rows, m where split in ('train', 'valid')"))
def m18(t: Tables):
    rows = models.mean_baseline(t.listings().withColumn("split", features.split_column("order_key")), "price")
    out = models.inspection_set(rows.where("split in ('train', 'valid')"), "price")
    return out.select("order_key", "split", "price", F.round("pred", 4).alias("pred"), F.round("resid", 4).alias("resid"), "ad_title")


@q("m19_compare_models", with_inputs("select strftime(original_post_date, '%Y-%m') as year_month, round(avg(250 + lon), 4) as mean_diff_in_pred, count(*) as n_rows from listings group by 1"))
def m19(t: Tables):
    rows = predicted(t)
    old = rows.select("order_key", (F.col("old_pred") - F.col("lon")).alias("pred"))
    both = models.attach_predictions(rows.drop("old_pred"), old, "order_key", "old_pred")
    out = aggregates.compare_predictions_by_month(both, "original_post_date")
    return out.select("year_month", F.round("mean_diff_in_pred", 4).alias("mean_diff_in_pred"), "n_rows")


@q("m20_missing_coordinates", with_inputs("select distinct location from listings where location not in (select location from places)"))
def m20(t: Tables):
    return joins.missing_coordinates(t.listings(), t.places())


@q("m20_backfill", with_inputs("select order_key, coalesce(p.lon, 1.5) as lon, coalesce(p.lat, 2.5) as lat from listings l left join places p using (location)"))
def m20_backfill(t: Tables):
    rows = joins.attach_coordinates(t.listings().select("order_key", "location"), t.places())
    found = joins.missing_coordinates(rows, t.places()).select("location", F.lit(1.5).alias("lon"), F.lit(2.5).alias("lat"))
    return joins.backfill_coordinates(rows, found).select("order_key", "lon", "lat")


PRICE_HISTORY = CPI + REGIONS + f""", sold as (select *, cast(customer_key as string) as key_url, case when still_for_sale = 'marked SOLD' then 'no' else 'Sold' end as state from listings),
kept as (select *, trim(split_part(location, ',', 2)) as country from sold where state like '%Sold%' and price > 100 and price < 20000 and price not in (123, 1234, 12345)
  and lower(description) not like '%stolen%' and lower(description) not like '%looking for%' and {BIKES}),
fx_months as (select currency, date_trunc('month', ts) as month, avg(rate) as rate from fx_raw group by 1, 2),
spans as (select currency, min(month) as a from fx_months group by 1),
calendar as (select currency, unnest(generate_series(a, timestamp '2003-12-01', interval 1 month)) as month from spans),
fx_filled as (select c.currency, c.month, last_value(m.rate ignore nulls) over (partition by c.currency order by c.month rows between unbounded preceding and current row) as rate from calendar c left join fx_months m on m.currency = c.currency and m.month = c.month),
adjusted as (select k.*, k.price * (f.most_recent_cpi / f.cpi) as price_cpi_adjusted, case when k.currency = 'CAD' then 1.0 else x.rate end as fx
  from kept k left join regions r on k.country = r.country left join filled f on f.region = r.cpi_region and f.year = year(k.last_repost_date)
  left join fx_filled x on x.currency = k.currency and x.month = date_trunc('month', k.last_repost_date)),
ranked as (select *, dense_rank() over (partition by key_url order by last_repost_date desc) as a, dense_rank() over (partition by key_url order by datetime_scraped desc) as b from adjusted)
"""


def sold_listings(t: Tables):
    state = F.when(F.col("still_for_sale") == "marked SOLD", "no").otherwise("Sold")
    return t.listings().withColumns({"url": F.col("customer_key").cast("string"), "still_for_sale": state})


@q("m21_price_history", with_inputs(PRICE_HISTORY + "select key_url as url, order_key, round(price_cpi_adjusted, 4) as price_cpi_adjusted, round(price_cpi_adjusted * fx, 4) as price_cpi_adjusted_CAD, coalesce(cast(watch_count as double), 0) as watch_count from ranked where a = 1 and b = 1"))
def m21(t: Tables):
    out = price_history.normalise_prices(sold_listings(t), yearly_cpi(t), t.fx(), 2003)
    return out.select("url", "order_key", *[F.round(c, 4).alias(c) for c in ("price_cpi_adjusted", "price_cpi_adjusted_CAD")], "watch_count")


BY_CURRENCY = (
    PRICE_HISTORY.replace(f" and {BIKES}", " and currency in ('CAD', 'USD')")
    .replace("f.region = r.cpi_region and f.year = year(k.last_repost_date)", "f.currency = k.currency and f.year = year(k.last_repost_date)")
    .replace("left join filled f", "left join by_currency f")
    .replace(
        ", sold as (",
        """, two as (select case region when 'canada' then 'CAD' else 'USD' end as currency, region from latest where region in ('canada', 'united-states')),
by_currency as (select t.currency, m.year, m.cpi, l.most_recent_cpi from two t join means m using (region) join latest l using (region)
  union all select t.currency, 2002, l.most_recent_cpi, l.most_recent_cpi from two t join latest l using (region)), sold as (""",
    )
)


@q("m21_price_history_by_currency", with_inputs(BY_CURRENCY + "select key_url as url, order_key, round(price_cpi_adjusted, 4) as price_cpi_adjusted, round(price_cpi_adjusted * fx, 4) as price_cpi_adjusted_CAD from ranked where a = 1 and b = 1"))
def m21_by_currency(t: Tables):
    currency = F.when(F.col("region") == "canada", "CAD").otherwise("USD")
    yearly = yearly_cpi(t).where("region in ('canada', 'united-states')").withColumn("currency", currency)
    cpi = price_history.cpi_with_current_year([yearly.select("year", "cpi", "most_recent_cpi", "currency")], 2002)
    out = price_history.normalise_prices(sold_listings(t), cpi, t.fx(), 2003, bikes_only=False, cpi_key="currency")
    return out.select("url", "order_key", *[F.round(c, 4).alias(c) for c in ("price_cpi_adjusted", "price_cpi_adjusted_CAD")])


SEARCH = {
    "price_limit_cad": 9000, "min_front_travel": 100, "max_front_travel": 170, "min_rear_travel": 0, "max_rear_travel": 160,
    "frame_size": "M", "category": "BUILDING Bikes", "lon": -114.07, "lat": -30.5, "distance_km_threshold": 12000, "max_results": 10,
}
SEARCH_ORACLE = SCORED + """, d as (select order_key, price, predicted_price, predicted_price - price as diff, url, 2 * 6371 * asin(sqrt(least(1, pow(sin(radians(lat + 30.5) / 2), 2) + cos(radians(-30.5)) * cos(radians(lat)) * pow(sin(radians(lon + 114.07) / 2), 2)))) as km from scored
where price_cad < 9000 and front between 100 and 170 and rear between 0 and 160 and frame_size_normalized = 'M' and category = 'BUILDING Bikes')
select url, price, round(predicted_price, 4) as predicted_price, round(diff, 4) as predicted_price_diff, round(km, 1) as distance_km from d where km <= 12000 order by diff desc nulls first, url limit 10"""


def _found(df):
    return df.select("url", "price", F.round("predicted_price", 4).alias("predicted_price"), F.round("predicted_price_diff", 4).alias("predicted_price_diff"), "distance_km")


@q("m22_listing_search", with_inputs(SEARCH_ORACLE))
def m22(t: Tables):
    return _found(search.relevant_listings(scored_table(t), **SEARCH))


@q("m22_listing_search_sql", with_inputs(SEARCH_ORACLE))
def m22_sql(t: Tables):
    p = SEARCH
    deals = search.deals_near(
        scored_table(t), p["price_limit_cad"], (p["min_front_travel"], p["max_front_travel"]), (p["min_rear_travel"], p["max_rear_travel"]),
        p["frame_size"], p["category"], p["lon"], p["lat"], p["distance_km_threshold"],
    )
    return _found(search.best_deals_sql(deals, p["max_results"]))


@q("o08_coefficient_table")
def o08(t: Tables):
    from marketloom.operators.sorting import coefficient_table

    rows = training_rows(t)
    model = models.fit(_stages(models.robust_linear()), _train(rows))
    names = [*NUMBERS, *[f"l_returnflag_{v}" for v in model.stages[0].labelsArray[0]], "l_returnflag_other"]
    table = coefficient_table(models.coefficients(model.stages[-1], names, t.spark), "l_")
    return table.withColumns({c: F.round(c, 3) for c in ("importance", "abs_importance")})
