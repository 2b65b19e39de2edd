"""Text features that are fitted once and applied to unseen rows: n-gram counts, weighted and normalised, as Spark ML stages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .features import tokens
from .sorting import top_k_of_many

CELLS = 1 << 20
WORDS_PER_SLICE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def frequent_terms(df: DataFrame, terms: Column, n: int, cells: int = CELLS) -> DataFrame:
    """The n most frequent terms of an array column, ties by name, with `total` occurrences and `df` rows; exact.

    Long n-grams are nearly all different, so counting each of them would shuffle
    more than the texts. Instead the first pass counts occurrences per hash cell
    (at most `cells` rows leave a task, and they add up in any order). No
    term is more frequent than its cell. The second pass counts the terms of the
    fullest cells; the n-th of them bounds the answer from below, so cells that
    hold less than that are out. If further cells hold as much, a third pass
    counts their terms too. Only the terms of such cells travel.
    """
    return frequent_ngrams(df, terms, n, 1, 1, cells)


def frequent_ngrams(df: DataFrame, words: Column, n: int, n_min: int, n_max: int, cells: int = CELLS) -> DataFrame:
    """`frequent_terms` of all runs of `n_min` to `n_max` words of an array column, joined by blanks.

    The tasks number the words of some texts and take runs by their numbers; a run
    becomes a text only where its cell is counted, once per text slice.
    """
    lists = df.select(words.alias("words"))

    def per_cell(batches):
        sizes = np.zeros(cells, dtype=np.int64)
        for part in _slices(batches):
            for _, _, keys in _runs(part, n_min, n_max):
                sizes += np.bincount(_cell(keys, cells), minlength=cells)
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used])], names=["cell", "size"])

    parts = lists.mapInArrow(per_cell, "cell long, size long")
    sizes = materialize(parts.groupBy("cell").agg(F.sum("size").alias("size")), "cells")

    def counted(low: int, below: int | None) -> DataFrame:
        chosen = sizes.where(F.col("size") >= low)
        if below is not None:
            chosen = chosen.where(F.col("size") < below)
        wanted = np.zeros(cells, dtype=bool)
        wanted[chosen.select("cell").toPandas()["cell"].to_numpy(dtype=np.int64)] = True  # at most `cells` numbers
        shared = df.sparkSession.sparkContext.broadcast(np.packbits(wanted))

        def inside(batches):
            table = np.unpackbits(shared.value, count=cells).astype(bool)
            for part in _slices(batches):
                for size, starts, keys in _runs(part, n_min, n_max):
                    held = table[_cell(keys, cells)]
                    found = _counts(part, size, starts[held], keys[held])
                    yield pa.RecordBatch.from_arrays(list(found), names=["term", "total", "df"])

        found = lists.mapInArrow(inside, "term string, total long, df long")
        return materialize(found.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")), "terms")

    floor = sizes.orderBy(F.desc("size")).limit(2 * n).agg(F.min("size")).first()[0]
    if floor is None:
        return sizes.select(F.lit("").alias("term"), F.lit(0).alias("total"), F.lit(0).alias("df")).limit(0)
    found = counted(floor, None)
    best = top_k_of_many(found, "total", n, ["term"]).agg(F.count("term"), F.min("total")).first()
    least = best[1] if best[0] == n else 0
    if sizes.where((F.col("size") < floor) & (F.col("size") >= least)).limit(1).count():
        found = found.unionByName(counted(least, floor))
    return top_k_of_many(found, "total", n, ["term"])


class _Slice(NamedTuple):
    """Some whole texts: their distinct words, the numbers of their words in order, the text of each and the words left in it."""

    names: np.ndarray
    codes: np.ndarray
    owner: np.ndarray
    left: np.ndarray


def _slices(batches) -> Iterator[_Slice]:
    """Whole texts of about `WORDS_PER_SLICE` words at a time; a longer text is a slice of its own."""
    for batch in batches:
        column = batch.column(0)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = column.flatten().dictionary_encode()
        names = np.array(words.dictionary.to_pylist() or [""], dtype=object)
        numbers = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        first = 0
        while first < len(lengths):
            start = ends[first] - lengths[first]
            last = max(first + 1, int(np.searchsorted(ends, start + WORDS_PER_SLICE, side="right")))
            owner = np.repeat(np.arange(first, last), lengths[first:last])
            left = ends[owner] - np.arange(start, ends[last - 1])
            yield _Slice(names, numbers[start : ends[last - 1]], owner, left)
            first = last


def _runs(part: _Slice, n_min: int, n_max: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, first places, hash keys) of the runs of each length; a missing word is in none."""
    words = pd.util.hash_array(part.names, categorize=False)[part.codes] if len(part.codes) else np.zeros(0, dtype=np.uint64)
    keys, whole = words, part.codes >= 0
    for size in range(1, n_max + 1):
        if size > 1:
            keys = keys[:-1] * _FACTOR + words[size - 1 :]
            whole = whole[:-1] & (part.codes[size - 1 :] >= 0)
        if size >= n_min and len(keys):
            starts = np.flatnonzero((part.left[: len(keys)] >= size) & whole)
            yield size, starts, keys[starts]
        if len(keys) < 2:
            return


def _cell(keys: np.ndarray, cells: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * _FACTOR
    return ((mixed >> np.uint64(17)) % np.uint64(cells)).astype(np.int64)


def _counts(part: _Slice, size: int, starts: np.ndarray, keys: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Distinct runs of a slice, how often they occur and in how many texts."""
    _, heads, term = np.unique(keys, return_index=True, return_inverse=True)
    same = np.ones(len(starts), dtype=bool)
    for k in range(size):
        same &= part.codes[starts + k] == part.codes[starts[heads[term]] + k]
    if not same.all():  # two runs share a key: tell them apart by their words
        runs = np.column_stack([part.codes[starts + k] for k in range(size)])
        _, heads, term = np.unique(runs, axis=0, return_index=True, return_inverse=True)
        term = term.ravel()
    order = np.argsort(term, kind="stable")
    owner, sorted_term = part.owner[starts[order]], term[order]
    fresh = np.append(True, (sorted_term[1:] != sorted_term[:-1]) | (owner[1:] != owner[:-1])) if len(order) else np.zeros(0, dtype=bool)
    texts = [" ".join(part.names[part.codes[s : s + size]]) for s in starts[heads]]
    totals = np.bincount(term, minlength=len(heads)).astype(np.int64)
    rows = np.bincount(sorted_term[fresh], minlength=len(heads)).astype(np.int64)
    return pa.array(texts, pa.string()), pa.array(totals), pa.array(rows)


class TextTokens(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Word n-grams of a text column; a null text has none."""

    nMin = Param(Params._dummy(), "nMin", "shortest n-gram", TypeConverters.toInt)
    nMax = Param(Params._dummy(), "nMax", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "tokens", nMin: int = 1, nMax: int = 1):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="text", outputCol="tokens", nMin=1, nMax=1)

    def column(self) -> Column:
        found = tokens(F.col(self.getInputCol()), self.getOrDefault(self.nMin), self.getOrDefault(self.nMax))
        return F.coalesce(found, F.array().cast("array<string>"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.column())


class TextTerms(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the most frequent n-grams of a text column and their weights.

    The fitted stages count a row's n-grams inside the row (nothing is
    exchanged), weight them by smoothed idf plus one and scale the row to length
    one. All of them can be saved; unseen terms count nothing, and a text without
    any known term is a vector of zeros. The vocabulary, `maxFeatures` terms at
    most, is the model and passes through the driver; a column without a single
    term cannot be fitted.
    """

    nMin = Param(Params._dummy(), "nMin", "shortest n-gram", TypeConverters.toInt)
    nMax = Param(Params._dummy(), "nMax", "longest n-gram", TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms kept", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCol: str = "text", outputCol: str = "features", nMin: int = 1, nMax: int = 5, maxFeatures: int = 100_000
    ):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="text", outputCol="features", nMin=1, nMax=5, maxFeatures=100_000)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        output = self.getOutputCol()
        cut = TextTokens(
            inputCol=self.getInputCol(), outputCol=f"{output}_tokens", nMin=self.getOrDefault(self.nMin), nMax=self.getOrDefault(self.nMax)
        )
        n_texts = dataset.count()
        lengths = (self.getOrDefault(self.nMin), self.getOrDefault(self.nMax))
        terms = frequent_ngrams(dataset, tokens(F.col(self.getInputCol())), self.getOrDefault(self.maxFeatures), *lengths)
        weight = F.log((F.lit(n_texts) + 1) / (F.col("df") + 1)) + 1
        learned = terms.select("term", weight.alias("idf")).orderBy("term").collect()
        if not learned:
            raise ValueError(f"{self.getInputCol()} holds no term to learn")
        counts = CountVectorizerModel.from_vocabulary(
            [r.term for r in learned], inputCol=cut.getOutputCol(), outputCol=f"{output}_counts"
        )
        weights = ElementwiseProduct(
            scalingVec=Vectors.dense([r.idf for r in learned]), inputCol=f"{output}_counts", outputCol=f"{output}_weights"
        )
        return PipelineModel([cut, counts, weights, Normalizer(p=2.0, inputCol=f"{output}_weights", outputCol=output)])


def vocabulary(model: PipelineModel) -> list[str]:
    """Terms of a fitted `TextTerms` in the order of its vector."""
    return next(stage for stage in model.stages if isinstance(stage, CountVectorizerModel)).vocabulary


def term_weights(df: DataFrame, key: str, vector: str, terms: list[str]) -> DataFrame:
    """Rows (key, term, weight) of the non-zero places of a vector column."""
    places = F.transform(vector_to_array(vector), lambda x, i: F.struct(i.alias("place"), x.alias("weight")))
    rows = df.select(key, F.inline(F.filter(places, lambda p: p["weight"] != 0)))
    names = df.sparkSession.createDataFrame(list(enumerate(terms)), "place int, term string")
    return rows.join(F.broadcast(names), "place").select(key, "term", "weight")  # as many names as the model has
