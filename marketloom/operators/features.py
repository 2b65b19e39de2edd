"""Model features as columns and Spark ML stages."""

from __future__ import annotations

import math

from pyspark.ml import Transformer
from pyspark.ml.feature import MaxAbsScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..session import materialize, sized_broadcast
from .sorting import exact_quantiles, hashed_order, top_k_of_many


VOCABULARY_BROADCAST = 200_000
TEXT_BYTES_PER_TASK = 16_000_000


def split_column(key: str, seed: int = 42) -> Column:
    """train / valid / test at 70 / 15 / 15 by hashed key; a row keeps its split under any partitioning."""
    bucket = F.conv(F.substring(hashed_order(key, seed), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < 70, "train").when(bucket < 85, "valid").otherwise("test")


def listing_features(df: DataFrame, target: str = "price_cpi_adjusted_CAD") -> DataFrame:
    """The dense feature set: age, month, country, period flag and texts without years."""
    features = {
        "age_at_post": C.age_at_post("ad_title", "description", "original_post_date"),
        "post_month": F.date_format("original_post_date", "MMMM"),
        "country": C.country_pattern("location"),
        "covid_flag": C.covid_flag("original_post_date"),
        "title_text": C.remove_years("ad_title"),
        "description_text": C.remove_years("description"),
    }
    keep = [c for c in df.columns if c not in features]
    price = F.col(target) if target in df.columns else F.lit(None).cast("double")
    return df.select(*keep, *[v.alias(k) for k, v in features.items()], price.alias("target"))


class ListingFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """`listing_features` as a pipeline stage, so that a saved model scores raw listings."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return listing_features(dataset)


def one_hot_stages(columns: list[str]) -> list:
    """Index by frequency (ties by name), unseen and null values in a slot of their own, then one-hot."""
    indexed = [f"{c}_index" for c in columns]
    return [
        StringIndexer(inputCols=columns, outputCols=indexed, handleInvalid="keep", stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_onehot" for c in columns], handleInvalid="keep", dropLast=False),
    ]


def assemble_stages(inputs: list[str], scale: bool = True, output: str = "features") -> list:
    if not scale:
        return [VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep")]
    return [
        VectorAssembler(inputCols=inputs, outputCol="_raw", handleInvalid="keep"),
        MaxAbsScaler(inputCol="_raw", outputCol=output),
    ]


def tokens(text: str, n_min: int = 1, n_max: int = 1) -> Column:
    """Lower-cased word n-grams by the token pattern; a dot only starts or ends tokens of digits and signs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(fv.TOKEN_PATTERN), F.lit(0))
    if (n_min, n_max) == (1, 1):
        return words
    # Bound as a variable of its own, so that the words are cut once and not once per place.
    return F.get(F.transform(F.array(words), lambda w: F.flatten(F.array(*[_grams(w, n) for n in range(n_min, n_max + 1)]))), 0)


def _grams(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).when(words.isNotNull(), F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))


def tfidf(df: DataFrame, key: str, text: str, max_features: int | None = None, n_min: int = 1, n_max: int = 1) -> DataFrame:
    """Weights (key, term, weight): smoothed idf plus one, each text normalised to length one.

    Texts are partitioned by key once; counting, weighting and normalising then
    need no further shuffle of terms. There are as many partitions as the counted
    size of the texts needs, so a task's memory does not grow with the table. Term
    totals combine on the map side, so a term in most texts costs one row per task.
    The vocabulary is cut to the most frequent `max_features` terms.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(key, text).repartition(max(width, math.ceil(size / TEXT_BYTES_PER_TASK)), key)
    counts = placed.select(key, F.explode(tokens(text, n_min, n_max)).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    n_texts = df.agg(F.count(F.lit(1))).scalar()
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if max_features is not None:
        vocabulary = top_k_of_many(materialize(vocabulary, "vocabulary"), "total", max_features, ["term"])
    idf = vocabulary.select("term", (F.log((n_texts + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    if max_features is not None and max_features <= VOCABULARY_BROADCAST:
        idf = F.broadcast(idf)  # bounded by max_features
    weighted = counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("_w"))
    # A partition is one text, whose terms are bounded by its length.
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("_w") / norm).alias("weight"))


def target_encoding(df: DataFrame, column: str, target: str) -> DataFrame:
    """Category -> mean target shrunk to the overall mean by the ratio of variances."""
    stats = df.groupBy(column).agg(
        F.count(target).alias("n"), F.avg(target).alias("_mean"), F.var_pop(target).alias("_within")
    )
    overall = df.agg(F.struct(F.avg(target).alias("mean"), F.var_pop(target).alias("var"))).scalar()
    stats = stats.withColumn("_all", overall)
    between = F.col("_all.var") * F.col("n")
    share = F.coalesce(F.try_divide(between, between + F.col("_within")), F.lit(1.0))
    return stats.select(column, "n", (share * F.col("_mean") + (1 - share) * F.col("_all.mean")).alias("encoding"))


def target_encode(df: DataFrame, encodings: DataFrame, column: str, overall_mean: float, output: str) -> DataFrame:
    """Attach encodings; an unseen category gets the overall mean."""
    lookup = encodings.select(F.col(column).alias("_c"), F.col("encoding").alias(output))
    joined = df.join(sized_broadcast(lookup), F.col(column).eqNullSafe(F.col("_c")), "left").drop("_c")
    return joined.withColumn(output, F.coalesce(output, F.lit(float(overall_mean))))


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of all columns in two passes; a column without values has none and is left out."""
    return {c: m for c, (m,) in exact_quantiles(df, columns).items() if m is not None}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in medians.items()})


def max_abs_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over its largest absolute value; a column of zeros stays."""
    tops = df.agg(F.struct(*[F.max(F.abs(c)).alias(c) for c in columns])).scalar()
    wide = df.withColumn("_tops", tops)
    scaled = {c: F.when(F.col(f"_tops.{c}") == 0, F.col(c)).otherwise(F.col(c) / F.col(f"_tops.{c}")) for c in columns}
    return wide.withColumns(scaled).drop("_tops")


def feature_index(df: DataFrame, column: str) -> DataFrame:
    """The index each category gets: by frequency, ties by name."""
    model = StringIndexer(inputCol=column, outputCol="_i", stringOrderType="frequencyDesc", handleInvalid="skip").fit(df)
    labels = model.labelsArray[0]
    spark = df.sparkSession
    return spark.createDataFrame([(label, i) for i, label in enumerate(labels)], f"{column} string, category_index int")


