"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes look-alike letters of other scripts and digits that stand for letters.
The lexicon holds words and word beginnings whose log odds to stand in a toxic
document are high; phrases in which such a word is harmless are exceptions and
cancel it. The weights found in a text, normalised by its length, give its score.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import sent
from marketloom.session import materialize, sized_broadcast

# Cyrillic and Greek letters that look like Latin ones, and signs that are read as letters.
FOLDS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "г": "r",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ɑ": "a", "ı": "i", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
FOLDED = re.compile("[" + "".join(map(re.escape, FOLDS)) + "]")
NO_WORD = re.compile(r"[\W_]+")
BEGINNINGS = (4, 5, 6, 7)


@dataclass
class ToxicityModel:
    """Weights by entry (a word with a space behind it, or a word's beginning), exception phrases, and the logistic scale of the density."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    offset: float = -4.0
    slope: float = 0.0


def folded(text: str | None) -> str:
    """The words of a text in folded lower case, with one space around each."""
    if not text:
        return " "
    plain = unicodedata.normalize("NFKC", text).lower()
    return " " + NO_WORD.sub(" ", FOLDED.sub(lambda m: FOLDS[m[0]], plain)).strip() + " "


def _entries(word: str) -> list[str]:
    return [word + " ", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def _entry_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts[int(toxic)].update({e for w in set(folded(text).split()) for e in _entries(w)})
    names = list(counts[1])  # an entry of clean documents only says nothing here
    if names:
        yield pd.DataFrame({"entry": names, "toxic": [counts[1][e] for e in names], "clean": [0] * len(names)})
    names = list(counts[0])
    for start in range(0, len(names), 200_000):
        part = names[start : start + 200_000]
        yield pd.DataFrame({"entry": part, "toxic": [0] * len(part), "clean": [counts[0][e] for e in part]})


def _automaton(model: ToxicityModel) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for entry, weight in model.lexicon.items():
        built.add_word(" " + entry, (weight, len(entry) + 1))
    for phrase in model.exceptions:
        built.add_word(f" {phrase} ", (None, len(phrase) + 2))
    built.make_automaton()
    return built


def hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) in folded text: for each place the heaviest entry that begins there, unless an exception covers it."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    covers = []
    for end, (weight, length) in automaton.iter(text):
        start = end - length + 1
        if weight is None:
            covers.append((start, end))
        elif start not in best or best[start][1] < weight:
            best[start] = (end, weight)
    covers.sort()
    kept, i, reach = [], 0, -1
    for start, (end, weight) in sorted(best.items()):
        while i < len(covers) and covers[i][0] <= start:
            reach = max(reach, covers[i][1])
            i += 1
        if end > reach:
            kept.append((start, end, weight))
    return kept


def density(automaton: ahocorasick.Automaton, text: str) -> float:
    """Weights found, by the logarithm of the number of words, on a logarithmic scale."""
    total = sum(w for _, _, w in hits(automaton, text))
    return math.log1p(total / math.log2(2 + text.count(" "))) if total else 0.0


def _phrase_counts(model: ToxicityModel):
    """Toxic and clean documents per phrase of a hit with the word in front of or behind it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(model)
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                plain = folded(text)
                seen = set()
                for start, end, _ in hits(automaton, plain):
                    stop = plain.index(" ", max(end, start + 1))
                    before = plain.rfind(" ", 0, start) if start else -1
                    after = plain.find(" ", stop + 1)
                    if before >= 0:
                        seen.add(plain[before + 1 : stop])
                    if after > 0:
                        seen.add(plain[start + 1 : after])
                counts.update((p, int(toxic)) for p in seen)
        if counts:
            yield pd.DataFrame({"phrase": [p for p, _ in counts], "toxic": [n if t else 0 for (_, t), n in counts.items()], "clean": [0 if t else n for (_, t), n in counts.items()]})

    return work


def _hit_lists(model: ToxicityModel):
    """The entries that each document hits, exceptions aside, and the least hash of its five-word strings, which near copies mostly share."""

    def least(plain: str) -> int:
        words = plain.split()
        return min(zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(model)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                plain = folded(text)
                found = sorted({plain[s + 1 : e + 1] for s, e, _ in hits(automaton, plain)})
                if found:
                    rows.append((toxic, found, least(plain)))
            yield pd.DataFrame(rows, columns=["toxic", "entries", "near"])

    return work


def _cover(groups: list[tuple[int, list[str]]], toxics: int, cleans: int, least_docs: int, least_z: float, least_odds: float) -> dict[str, float]:
    """Entries with their log odds, from the entries that documents hit: taken by falling standard score among documents that hold none taken before, and then all that are pure."""
    holders: dict[str, list[int]] = {}
    counts: dict[str, list[int]] = {}
    for g, (toxic, entries) in enumerate(groups):
        for e in entries:
            holders.setdefault(e, []).append(g)
            counts.setdefault(e, [0, 0])[toxic] += 1
    left, open_groups, taken = [cleans, toxics], [True] * len(groups), {}

    def judged(clean: int, toxic: int) -> tuple[float, float]:
        odds = math.log((toxic + 0.5) / (max(left[1] - toxic, 0) + 0.5)) - math.log((clean + 0.5) / (max(left[0] - clean, 0) + 0.5))
        return odds / math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), odds

    pure = {e: judged(clean, toxic) for e, (clean, toxic) in counts.items() if toxic >= 2 * least_docs and toxic >= 20 * clean}
    while True:
        able = [e for e, (clean, toxic) in counts.items() if toxic >= least_docs and toxic >= clean]
        best = max(((*judged(*counts[e]), e) for e in able), default=(0.0, 0.0, ""))
        if best[0] < least_z or best[1] < least_odds:
            return {e: odds for e, (z, odds) in pure.items() if z >= least_z} | taken
        taken[best[2]] = best[1]
        for g in holders[best[2]]:
            if open_groups[g]:
                open_groups[g] = False
                toxic, entries = groups[g]
                left[toxic] -= 1
                for e in entries:
                    counts[e][toxic] -= 1


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", most_docs: int = 40_000, least_docs: int = 5, least_z: float = 4.0, least_odds: float = 0.7) -> ToxicityModel:
    """Lexicon, exceptions and scale from documents and their labels by id (1 toxic, 0 not; other labels are left out).

    Bound: about ``most_docs`` whole documents, chosen by a hash of the id. An entry needs
    ``least_docs`` toxic documents and log odds of ``least_odds`` and of ``least_z`` standard
    errors; a longer one that is no purer than a shorter beginning is left out. An
    exception is a hit with its neighbour that ``least_docs`` clean documents hold and at most a fifth as many toxic ones.
    Entries are then taken one by one, the most telling first, each judged by the documents that hold none taken
    before; words that only stand beside a telling one so drop out, unless toxic documents alone hold them. Near copies count
    once here, lest one text speak for all its words.
    Without toxic and clean documents the model is empty and scores all the same.
    """
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1)")
    sizes = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    model = ToxicityModel()
    if len(sizes) < 2:
        return model
    place = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = sized_broadcast(told.filter(place < most_docs / sum(sizes.values())))
    sample = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")).join(chosen, "id").select("text", "toxic")
    sample = materialize(sample, "labelled")
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxics, cleans = max(1, seen.get(1, 0)), max(1, seen.get(0, 0))
    counts = sample.mapInPandas(_entry_counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxics - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (cleans - F.col("clean") + 0.5))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = (F.col("toxic") >= least_docs) & (F.col("weight") >= least_odds) & (F.col("weight") >= least_z * error)
    # The sample bounds what is collected: an entry stands in least_docs of its documents.
    found = counts.withColumn("weight", odds).filter(telling).orderBy(F.length("entry"), "entry").collect()
    purity: dict[str, float] = {}
    for r in found:
        pure = r["toxic"] / (r["toxic"] + r["clean"])
        word = r["entry"].rstrip(" ")
        shorter = [purity[word[:n]] for n in BEGINNINGS if n <= len(word) and word[:n] != r["entry"] and word[:n] in purity]
        if not shorter or pure > max(shorter) + 0.02:
            purity[r["entry"]] = pure
            model.lexicon[r["entry"]] = float(r["weight"])
    if not model.lexicon:
        return model
    phrases = sample.mapInPandas(_phrase_counts(model), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model.exceptions = {r["phrase"] for r in phrases.filter((F.col("clean") >= least_docs) & (F.col("toxic") * 4 <= F.col("clean"))).collect()}
    lists = sample.mapInPandas(_hit_lists(model), "toxic int, entries array<string>, near long")
    seen_hits = lists.groupBy("toxic", "near").agg(F.min("entries").alias("entries")).orderBy("toxic", "near").collect()
    model.lexicon = _cover([(r["toxic"], r["entries"]) for r in seen_hits], toxics, cleans, least_docs, least_z, least_odds)
    plain = _automaton(ToxicityModel(model.lexicon))
    model.exceptions = {p for p in model.exceptions if hits(plain, f" {p} ")}
    shown = _with_density(sample, model, "text").groupBy(F.round("_density", 1).alias("x"), "toxic").count().collect()
    x, y, n = (np.array([float(r[k]) for r in shown]) for k in ("x", "toxic", "count"))
    model.offset, model.slope = _logistic(x, y, n)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic fit of y on x by damped Newton steps; the ridge keeps it finite where the classes part cleanly."""
    at, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (n * (y - p)) - ridge * at
        bend = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.clip(np.linalg.solve(bend, slope), -1, 1)
        at = at + step
        if np.abs(step).max() < 1e-6:
            break
    return float(at[0]), float(max(at[1], 0.0))


def _with_density(docs: DataFrame, model: ToxicityModel, text_col: str) -> DataFrame:
    fitted = sent(docs.sparkSession, model)

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(fitted())
        for texts in batches:
            yield pa.array([density(automaton, folded(t.as_py())) for t in texts], pa.float64())

    return docs.withColumn("_density", F.arrow_udf(measure, "double")(F.col(text_col)))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows with ``toxicity`` (0 to 1) and ``toxic_pred`` (1 from 0.5 on).

    Null and empty texts have no hit and get the score of such texts. Columns of the
    same names are replaced; others stay as they are.
    """
    plain = docs.drop("toxicity", "toxic_pred")
    told = _with_density(plain.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), model, "_text")
    value = 1 / (1 + F.exp(-(F.lit(model.offset) + F.lit(model.slope) * F.col("_density"))))
    return told.select("_row.*", value.alias("toxicity")).withColumn("toxic_pred", F.when(F.col("toxicity") >= 0.5, 1).otherwise(0))
