"""Fuzzy matching of listing titles to a catalogue, and spec augmentation.

Scoring works on distinct texts. Texts and candidates meet in co-grouped
blocks: both sides of a block are cut into bounded slices, so a year that holds
most of the listings, or most of the catalogue, becomes many tasks. A task
returns only its best candidates per text; no (text, candidate) pair is emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..functions.similarity import WORD, CandidateTree, TextBlock, keep_best
from ..session import materialize, spread
from .windows import top_n

TEXTS_PER_SLICE = 20_000
CANDIDATES_PER_SLICE = 5_000
_SLACK = 1e-9  # covers rounding of bounds and scores


def _sliced(df: DataFrame, block: list[str], value: str, per_slice: int, name: str) -> DataFrame:
    """Number the slices of each block by hash; a block gets as many as its size needs."""
    sizes = df.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / per_slice).cast("int").alias(f"{name}_count"))
    slot = F.pmod(F.xxhash64(value), F.col(f"{name}_count").cast("bigint")).cast("int")
    return df.join(sizes, block).withColumn(name, slot)


def best_matches(
    texts: DataFrame,
    candidates: DataFrame,
    block: list[str],
    text: str = "text",
    candidate: str = "candidate",
    n: int = 1,
    threshold: float = 0.0,
    order: str | None = None,
) -> DataFrame:
    """Best n candidates per text inside a block, scored by partial ratio, at or above `threshold`.

    Ties go to the smaller `order` (default: the candidate itself). Columns:
    block, text, candidate, similarity.
    """
    tie = order or candidate
    right = candidates.select(*block, F.col(candidate).alias("_cand"), F.col(tie).cast("string").alias("_tie")).na.drop()
    # Written once: sizes, slices and scoring all read the distinct texts and candidates.
    left = materialize(texts.select(*block, text).na.drop().distinct(), "texts")
    right = materialize(right.distinct(), "candidates")
    left = _sliced(left, block, text, TEXTS_PER_SLICE, "_ts")
    right = _sliced(right, block, "_cand", CANDIDATES_PER_SLICE, "_cs")
    counts_left = left.groupBy(*block).agg(F.max("_ts_count").alias("_n"))
    counts_right = right.groupBy(*block).agg(F.max("_cs_count").alias("_m"))
    spread_left = left.join(counts_right, block).withColumn("_cs", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    spread_right = right.join(counts_left, block).withColumn("_ts", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    keys = [*block, "_ts", "_cs"]  # block first: the scorer reads it by position
    fields = [texts.schema[b] for b in block]
    schema = T.StructType(
        [*fields, T.StructField("_text", T.StringType()), T.StructField("_cand", T.StringType()),
         T.StructField("_tie", T.StringType()), T.StructField("similarity", T.DoubleType())]
    )
    scored = (
        full_width(spread_left.select(*keys, F.col(text).alias("_text")), keys)
        .groupBy(*keys)
        .cogroup(full_width(spread_right.select(*keys, "_cand", "_tie"), keys).groupBy(*keys))
        .applyInArrow(_score_slices(n, threshold), schema)
    )
    best = top_n(scored, [*block, "_text"], [F.desc("similarity"), F.asc("_tie"), F.asc("_cand")], n)
    return best.select(*block, F.col("_text").alias(text), F.col("_cand").alias(candidate), "similarity")


def full_width(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by key into the session's full width; a compute-heavy stage must not be coalesced by its small input."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def best_of_block(block: TextBlock, candidates: list[str], n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the best n candidates of each text; ties go to the earlier candidate (-1: none).

    Candidates shorter than the text are walked as a tree, whose work per text hardly grows with their number. Texts
    that are no longer than a candidate, and candidates without letters or of more than 64, are compared pair by pair
    where an upper bound reaches the threshold and the text's n-th best score so far.
    """
    lengths = np.array([len(c) for c in candidates], dtype=np.int64)
    short = np.flatnonzero((lengths > 0) & (lengths <= WORD))
    top, pick = CandidateTree([candidates[j] for j in short]).best(block, n, threshold, _SLACK)
    pick[pick >= 0] = short[pick[pick >= 0]]
    odd = np.flatnonzero((lengths == 0) | (lengths > WORD))
    _best_by_bounds(block, [(int(j), candidates[j]) for j in odd], top, pick, threshold)
    low = np.flatnonzero(block.lengths <= lengths[short].max(initial=-1))
    if len(low):
        some = TextBlock([block.texts[i] for i in low])
        best, place = top[low], pick[low]
        long_enough = short[lengths[short] >= some.lengths.min()]
        _best_by_bounds(some, [(int(j), candidates[j]) for j in long_enough], best, place, threshold, longer=False)
        top[low], pick[low] = best, place
        block.scored += some.scored
    return top, pick


def _best_by_bounds(block: TextBlock, candidates: list[tuple[int, str]], top: np.ndarray, pick: np.ndarray, threshold: float, longer: bool = True) -> None:
    """Merge the candidates (place, text) into the best of each text; without `longer`, only texts no longer than the candidate.

    The candidate of the highest bound comes first, so that the later ones meet a high score from the start.
    """

    def bounds(candidate: str) -> np.ndarray:
        found = block.bounds(candidate)
        return found if longer else np.where(block.lengths <= len(candidate), found, -1.0)

    def score(place: int, candidate: str, rows: np.ndarray) -> None:
        if len(rows):
            keep_best(top, pick, rows, block.partial_ratios(candidate, rows), np.full(len(rows), place))

    highest, seed = np.full(len(block.texts), -1.0), np.full(len(block.texts), -1, dtype=np.int64)
    for i, (_, candidate) in enumerate(candidates):
        bound = bounds(candidate)
        higher = bound > highest
        highest[higher], seed[higher] = bound[higher], i
    for i in np.unique(seed[seed >= 0]):
        score(*candidates[i], np.flatnonzero((seed == i) & (highest >= np.maximum(top[:, -1], threshold) - _SLACK)))
    for i, (place, candidate) in enumerate(candidates):
        hopeful = bounds(candidate) >= np.maximum(np.maximum(top[:, -1], threshold) - _SLACK, 0.0)
        score(place, candidate, np.flatnonzero(hopeful & (seed != i)))


def _score_slices(n: int, threshold: float):
    """Score one slice of texts against one slice of candidates; the first columns of both are the block."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column_names[:-3]
        fields = [left.schema.field(b) for b in block]
        strings = [pa.field(c, pa.string()) for c in ("_text", "_cand", "_tie")]
        schema = pa.schema([*fields, *strings, pa.field("similarity", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        candidates = sorted(zip(right["_tie"].to_pylist(), right["_cand"].to_pylist()))
        texts = left["_text"].to_pylist()
        top, pick = best_of_block(TextBlock(texts), [c for _, c in candidates], n, threshold)
        rows, slots = np.nonzero((pick >= 0) & (top >= threshold))
        chosen = [candidates[j] for j in pick[rows, slots]]
        return pa.Table.from_arrays(
            [
                *[left[b].take(pa.array(rows)) for b in block],
                pa.array([texts[i] for i in rows], pa.string()),
                pa.array([c for _, c in chosen], pa.string()),
                pa.array([o for o, _ in chosen], pa.string()),
                pa.array(top[rows, slots], pa.float64()),
            ],
            schema=schema,
        )

    return score


def fuzzy_match(
    listings: DataFrame,
    catalogue: DataFrame,
    year: str = "year",
    title: str = "ad_title",
    maker: str = "manufacturer",
    model: str = "model",
    n: int = 1,
    maker_threshold: float = 70,
    model_threshold: float = 70,
    maker_order: str | None = None,
) -> DataFrame:
    """Distinct (year, title) with their best maker and best n models of that maker.

    The maker is chosen first among the makers of the year; below its threshold,
    and for years the catalogue does not know, the title has no match.
    """
    titles = listings.select(F.col(year).cast("string").alias("_y"), F.lower(title).alias("_t")).na.drop().distinct()
    # Written once: makers and models both read the entries, which may be parsed from urls.
    entries = catalogue.select(F.col(year).cast("string").alias("_y"), F.col(maker).alias("_maker"), F.col(model).alias("_model"), F.col(maker_order or maker).alias("_order"))
    entries = materialize(entries, "entries")
    makers = entries.groupBy("_y", "_maker").agg(F.min("_order").cast("string").alias("_o"))
    with_maker = best_matches(titles, makers, ["_y"], "_t", "_maker", 1, maker_threshold, "_o")
    models = entries.select("_y", "_maker", "_model")
    found = best_matches(with_maker.select("_y", "_maker", "_t"), models, ["_y", "_maker"], "_t", "_model", n, model_threshold)
    return found.select(
        F.col("_y").alias("match_year"), F.col("_t").alias("match_title"), F.col("_maker").alias("match_maker"),
        F.col("_model").alias("match_model"), F.col("similarity"),
    )


def spec_catalogue(specs: DataFrame, url: str = "spec_url") -> DataFrame:
    """Maker, year and model from the spec url, and the readable catalogue key; the rows are dealt out before they are parsed."""
    parts = spread(specs).withColumns(C.spec_url_parts(url))
    return parts.withColumn("year_manufacturer_model", C.catalogue_key("year", "manufacturer", "model"))


def augment_with_specs(
    listings: DataFrame,
    catalogue: DataFrame,
    year_col: str = "year",
    ad_title_col: str = "ad_title",
    maker_threshold: float = 80,
    model_threshold: float = 75,
) -> DataFrame:
    """Left join the best matching catalogue entry and parse its numbers.

    `catalogue` is a `spec_catalogue`; entries that share a key count once (the
    smallest spec url).
    """
    readable = catalogue.withColumn("model", F.lower(F.regexp_replace("model", "-", " ")))
    matches = fuzzy_match(
        listings, readable, "year", ad_title_col, maker_threshold=maker_threshold, model_threshold=model_threshold
    ) if year_col == "year" else fuzzy_match(
        listings.withColumnRenamed(year_col, "year"), readable, "year", ad_title_col,
        maker_threshold=maker_threshold, model_threshold=model_threshold,
    )
    key = F.concat_ws(" ", "match_year", "match_maker", "match_model")
    matches = matches.select("match_year", "match_title", key.alias("fuzzy_match"))
    joined = listings.join(
        matches,
        (F.col(year_col).cast("string") == F.col("match_year")) & (F.lower(ad_title_col) == F.col("match_title")),
        "left",
    ).drop("match_year", "match_title")
    one = top_n(catalogue.where(F.col("year_manufacturer_model").isNotNull()), ["year_manufacturer_model"], [F.asc("spec_url")])
    one = one.drop("year").withColumnRenamed("year_manufacturer_model", "_key")
    out = joined.join(one, F.col("fuzzy_match") == F.col("_key"), "left").withColumnRenamed("_key", "year_manufacturer_model")
    return with_spec_numbers(out)


def with_spec_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "msrp_cleaned": C.list_price("msrp_summary"),
            "weight_summary": C.matched_number("weight_summary", fv.WEIGHT_PATTERN),
            "front_travel_summary": C.matched_number("travel_summary", fv.FRONT_TRAVEL_PATTERN),
            "rear_travel_summary": C.matched_number("travel_summary", fv.REAR_TRAVEL_PATTERN),
        }
    )
