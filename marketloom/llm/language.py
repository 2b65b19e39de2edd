"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts the letters of a word from the three in front of
them. The n-grams of all languages share sorted arrays of 64-bit hashes; beside each
hash stand the log probabilities, already interpolated, under every language. A text
gets the language of the lowest cross-entropy per symbol, and is rejected when that
lies above what texts of the nearest other language show under the same model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import scramble, sent

ORDER = 4
EDGE = 10  # stands in front of and behind each word
WORDS = re.compile(r"[^\W\d_]+")
SLAB_CHARS = 1_000_000
CACHED_WORDS = 300_000
HELD = 1 / 6  # share of the counted documents that is held back for calibration
LEAST_JUDGED = 50  # documents of a language that judge the models of the others, if it has so many
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Log probabilities of n-grams by order; ``spread`` is their deviation per symbol, ``limits`` the highest cross-entropy that is accepted."""

    languages: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    floor: np.ndarray
    spread: np.ndarray
    limits: np.ndarray | None = None


def letters_of(text: str | None) -> list[str]:
    """The words of a text in lower case; none if it has no letter."""
    words = WORDS.findall(text.lower()) if text else []
    return words if any(any(c.isalpha() for c in w) for w in words) else []


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words with edges between them, and the places to predict: all letters and each word's end."""
    gap = chr(EDGE) * (ORDER - 1)
    codes = np.frombuffer((gap + gap.join(words) + gap).encode("utf-32-le"), np.uint32).astype(np.uint64)
    letter = codes != EDGE
    return codes, np.flatnonzero(letter | np.r_[False, letter[:-1]])


def gram_hash(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place."""
    h = np.full(len(at), n, np.uint64)
    for back in range(n - 1, -1, -1):
        h = (h + codes[at - back]) * np.uint64(0x9E3779B97F4A7C15)
    return scramble(h)


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[tuple[str, bool], Counter] = {}
    for batch in batches:
        for text, lang, held in zip(batch["text"], batch["lang"], batch["held"]):
            seen.setdefault((lang, held), Counter()).update(letters_of(text))
    for (lang, held), counts in seen.items():
        words = list(counts)
        grams: Counter = Counter()
        for start in range(0, len(words), 50_000):
            part = words[start : start + 50_000]
            codes, at = symbols(part)
            weight = np.repeat(np.fromiter((counts[w] for w in part), np.int64), [len(w) + 1 for w in part])
            _, first, inverse = np.unique(gram_hash(codes, at, ORDER), return_index=True, return_inverse=True)
            sums = np.bincount(inverse, weights=weight).astype(np.int64)
            window = codes[at[first][:, None] + np.arange(1 - ORDER, 1)].astype(np.uint32)
            text = window.tobytes().decode("utf-32-le")
            for i, n in enumerate(sums.tolist()):
                grams[text[i * ORDER : (i + 1) * ORDER]] += n
        if grams:
            yield pd.DataFrame({"lang": lang, "held": held, "gram": list(grams), "n": list(grams.values())})


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def _smoothed(counts: list[tuple[str, str, int]]) -> LanguageModel | None:
    """Kneser-Ney estimates from counts of (language, n-gram, n)."""
    languages = sorted({c[0] for c in counts})
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    grams = np.frombuffer("".join(c[1] for c in counts).encode("utf-32-le"), np.uint32).reshape(-1, ORDER).astype(np.uint64)
    owner = np.array([number[c[0]] for c in counts])
    raw = np.array([c[2] for c in counts], np.float64)
    width = len(languages)

    def hashed(rows: np.ndarray, n: int) -> np.ndarray:
        flat = np.ascontiguousarray(rows[:, ORDER - n :]).reshape(-1)
        return gram_hash(flat, np.arange(len(rows)) * n + n - 1, n)

    alphabet = len(np.unique(grams[:, -1])) + 1
    tables, logs, context_tables, backoffs = [], [], [], []
    lower, lower_table = None, None
    floor = np.zeros(width)
    for n in range(1, ORDER + 1):
        table, first = np.unique(hashed(grams, n), return_index=True)
        types = grams[first]
        slot = np.searchsorted(table, hashed(grams, n))
        freq = np.zeros((len(table), width))
        if n == ORDER:
            np.add.at(freq, (slot, owner), raw)
        else:
            _, once = np.unique(np.stack([hashed(grams, n + 1), owner.astype(np.uint64)], 1), axis=0, return_index=True)
            np.add.at(freq, (slot[once], owner[once]), 1.0)
            if n > 1:  # an n-gram at a word's start has one left neighbour only, so its own count speaks
                start = np.zeros_like(freq)
                np.add.at(start, (slot, owner), raw)
                at_start = types[:, ORDER - n] == EDGE
                freq[at_start] = start[at_start]
        below = np.full((len(table), width), 1.0 / alphabet)
        if n > 1:
            below = lower[np.searchsorted(lower_table, hashed(types, n - 1))]
        context = gram_hash(np.ascontiguousarray(types[:, ORDER - n : -1]).reshape(-1), np.arange(len(types)) * (n - 1) + n - 2, n - 1) if n > 1 else np.zeros(len(types), np.uint64)
        context_table, group = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(context_table), width)), np.zeros((len(context_table), width))
        np.add.at(total, group, freq)
        np.add.at(kinds, group, freq > 0)
        ones, twos = (freq == 1).sum(0), (freq == 2).sum(0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.95)
        free = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        prob = np.maximum(freq - discount, 0) / np.maximum(total, 1)[group] + free[group] * below
        if n == 1:
            floor = free[0] / alphabet
        tables.append(table)
        logs.append(np.log(prob).astype(np.float32))
        context_tables.append(context_table)
        backoffs.append(np.log(free).astype(np.float32))
        lower, lower_table = prob, table
    weight = np.zeros((len(tables[-1]), width))
    np.add.at(weight, (np.searchsorted(tables[-1], hashed(grams, ORDER)), owner), raw)
    share = weight / weight.sum(0)
    mean = (share * logs[-1]).sum(0)
    spread = np.sqrt((share * (logs[-1] - mean) ** 2).sum(0))
    return LanguageModel(languages, tables, logs, context_tables, backoffs, np.log(floor).astype(np.float32), spread)


def log_probabilities(model: LanguageModel, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of each place under each language: the longest known n-gram, else its context's share of the shorter one."""
    out = np.zeros((len(at), len(model.languages)), np.float32)
    todo = np.arange(len(at))
    for n in range(ORDER, 0, -1):
        slot, known = _find(model.hashes[n - 1], gram_hash(codes, at[todo], n))
        out[todo[known]] += model.logs[n - 1][slot[known]]
        todo = todo[~known]
        if not len(todo):
            return out
        if n > 1:
            slot, met = _find(model.contexts[n - 1], gram_hash(codes, at[todo] - 1, n - 1))
            out[todo[met]] += model.backoffs[n - 1][slot[met]]
    out[todo] += model.floor
    return out


class _Scores(dict):
    """Word -> row of ``sums``; words are scored in groups, so a new one gets its row first."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.fresh, self.sums = model, [], np.zeros((0, len(model.languages)))

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.fresh.append(word)
        return row

    def settle(self) -> None:
        if self.fresh:
            codes, at = symbols(self.fresh)
            ends = np.cumsum([len(w) + 1 for w in self.fresh])
            logs = log_probabilities(self.model, codes, at)
            self.sums = np.concatenate([self.sums, np.add.reduceat(logs, np.r_[0, ends[:-1]], axis=0, dtype=np.float64)])
            self.fresh = []


def cross_entropies(model: LanguageModel, texts: Iterator[str | None], scores: _Scores) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each text and its cross-entropy per symbol under each language."""
    rows, sizes = [], []
    for text in texts:
        words = letters_of(text)
        rows.append(np.fromiter(map(scores.__getitem__, words), np.int64, len(words)))
        sizes.append(sum(map(len, words)) + len(words))
    scores.settle()
    out = np.zeros((len(rows), len(model.languages)))
    for i, row in enumerate(rows):
        if len(row):
            out[i] = -scores.sums[row].sum(0) / sizes[i]
    return np.array(sizes, np.int64), out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 2000) -> LanguageModel | None:
    """Model from labelled documents.

    Bound: about ``docs_per_language`` whole documents of each language, chosen by a hash of
    the id, are counted; a smaller language is counted in full. The same documents calibrate the
    rejection at every size: each language's model is judged by documents of the others, which it does not
    count, and a language that stands alone by a sixth of its own, under a model of the other five. Null
    languages are left out; without any labelled text there is no model.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")).filter("lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None

    def by_size(of) -> Column:
        return F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(float(of(n))))]), F.col("lang"))

    hashed = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    placed = labelled.withColumn("place", hashed / by_size(lambda n: min(1, docs_per_language / n))).filter("place < 1").drop("id")
    placed = placed.withColumn("held", F.col("place") >= 1 - HELD)
    grams = placed.select("text", "lang", "held").mapInPandas(_gram_counts, "lang string, held boolean, gram string, n long")
    counts = [tuple(r) for r in grams.groupBy("lang", "gram").agg(F.sum("n"), F.sum(F.when(F.col("held"), 0).otherwise(F.col("n")))).orderBy("lang", "gram").collect()]
    model = _smoothed([r[:3] for r in counts])
    if model is None:
        return None
    model.limits = np.full(len(model.languages), np.inf)  # nothing to judge by: reject nothing
    if len(model.languages) > 1:
        seen = _means(placed.filter(F.col("place") >= by_size(lambda n: 1 - max(HELD, LEAST_JUDGED / min(n, docs_per_language)))), model)
        for i, name in enumerate(model.languages):
            model.limits[i] = min((row[i] for lang, row in seen.items() if lang != name), default=np.inf)
    elif part := _smoothed([(lang, gram, n) for lang, gram, _, n in counts if n]):
        model.limits[:] = [2 * row[0] for row in _means(placed.filter("held"), part).values()] or np.inf
    return model


def _means(docs: DataFrame, model: LanguageModel) -> dict[str, list[float]]:
    """Language of the documents -> mean cross-entropy of its texts under each model; very short texts are left out."""
    told = _scored(docs, model, "text")
    # A filter would score the texts a second time, below it.
    means = [F.avg(F.when(F.col("_symbols") >= 40, F.col("_all")[i])) for i in range(len(model.languages))]
    return {r[0]: list(r[1:]) for r in told.groupBy("lang").agg(*means).collect() if r[1] is not None}


def _scored(docs: DataFrame, model: LanguageModel, text_col: str) -> DataFrame:
    """The rows with _best, _score, _cross, _symbols, _rejected and _all, the cross-entropies under all languages."""
    fitted = sent(docs.sparkSession, model)
    deviations = 4.0

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = fitted()
        scores = _Scores(model)
        for texts in batches:
            columns: list[list] = [[] for _ in range(6)]
            start = 0
            while start < len(texts):
                held, chars = [], 0
                while start < len(texts) and chars < SLAB_CHARS:
                    held.append(texts[start].as_py())
                    chars += len(held[-1] or "") + 100
                    start += 1
                sizes, cross = cross_entropies(model, held, scores)
                best = cross.argmin(1)
                low = cross[np.arange(len(best)), best]
                shape = np.exp(-(cross - low[:, None]) * np.minimum(sizes, 50)[:, None])
                score = np.where(sizes > 0, 1.0 / shape.sum(1), 0.0)
                rejected = sizes == 0
                if model.limits is not None:
                    rejected |= low > model.limits[best] + deviations * model.spread[best] / np.sqrt(np.maximum(sizes, 1))
                for column, values in zip(columns, (np.where(sizes > 0, np.array(model.languages, object)[best], UNKNOWN), score, low, sizes, rejected, cross)):
                    column.extend(values.tolist())
                if len(scores) > CACHED_WORDS:
                    scores = _Scores(model)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.float64())))], fields)

    fields = ["best", "score", "cross", "symbols", "rejected", "all"]
    of = F.arrow_udf(judge, "best string, score double, cross double, symbols long, rejected boolean, all array<double>")
    told = docs.withColumn("_judged", of(F.col(text_col)))
    return told.select("*", *[F.col(f"_judged.{f}").alias(f"_{f}") for f in fields]).drop("_judged")


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred``, ``lang_score`` (0 to 1), ``cross_entropy`` per symbol and ``lang_rejected``.

    Null texts and texts without a letter are ``und`` with score 0, and rejected.
    Equal cross-entropies go to the language first by code point. Without a model all
    rows are ``und``. Columns of the same names are replaced; others stay as they are.
    """
    new = ["lang_pred", "lang_score", "cross_entropy", "lang_rejected"]
    plain = docs.drop(*new)
    if model is None:
        return plain.withColumns(dict(zip(new, (F.lit(UNKNOWN), F.lit(0.0), F.lit(None).cast("double"), F.lit(True)))))
    told = _scored(plain.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), model, "_text")
    return told.select("_row.*", F.col("_best").alias("lang_pred"), F.col("_score").alias("lang_score"), F.col("_cross").alias("cross_entropy"), F.col("_rejected").alias("lang_rejected"))
