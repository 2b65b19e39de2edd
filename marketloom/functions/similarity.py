"""Text similarity: partial ratio, vectorised over a batch, and accent folding."""

from __future__ import annotations

import unicodedata
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
_NO_LETTER = 0xFFFFFFFF


def _lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows on a Python integer."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        match = row & masks.get(ch, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def _best_window(short: str, long: str) -> float:
    """Best indel ratio of `short` against the windows of `long`, cut windows at both ends included."""
    m, n = len(short), len(long)
    best = 0.0
    for start in range(1 - m, n):
        window = long[max(start, 0) : min(start + m, n)]
        if window:
            best = max(best, 200.0 * _lcs_length(short, window) / (m + len(window)))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Similarity 0..100 of the shorter text with its best alignment in the longer one."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if a in b or b in a:
        return 100.0
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(a, b) if len(a) < len(b) else _best_window(b, a)


class TextBlock:
    """A batch of texts laid out end to end, so that one candidate is scored against many of them at once.

    `bounds` gives an upper bound of every partial ratio from the letters and letter pairs in common, read
    from an inverted index. Let the shorter text have s letters, share B letters and Q letter pairs with the
    other one, and have L letters in common order with its best window of w letters. Then L <= B, and since a
    letter left out breaks two pairs and a letter put in breaks one, Q >= s - 1 - 2 (s - L) - (w - L). Both
    with L <= w give a ratio of at most 200 b / (s + b), b the lesser of B and (Q + s + 1) / 2.
    """

    ROWS = 1_024  # rows per pass, so that the working arrays stay in cache
    CELLS = 1_000_000  # letters per pass, so that a few very long texts take passes of their own

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.alphabet, letters = np.unique(codes, return_inverse=True)
        self.letters = np.append(letters, 0).astype(np.int32)
        self.scored = 0  # pairs of a text and a candidate that got a score
        self.visited = 0  # pairs of a text and a beginning of candidates that were looked at

    @cached_property
    def _owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.lengths)

    @cached_property
    def _letters_of(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return _postings(self.alphabet[self.letters[:-1]].astype(np.int64), self._owner)

    @cached_property
    def _pairs_of(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        codes, paired = self.alphabet[self.letters[:-1]].astype(np.int64), self._owner[1:] == self._owner[:-1]
        return _postings(codes[:-1][paired] << 32 | codes[1:][paired], self._owner[1:][paired])

    def bounds(self, candidate: str) -> np.ndarray:
        """For each text a number that its partial ratio with the candidate cannot exceed."""
        points = np.frombuffer(candidate.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        shorter = np.minimum(self.lengths, len(points))
        common = _in_common(self._letters_of, points, len(self.texts))
        pairs = _in_common(self._pairs_of, points[:-1] << 32 | points[1:], len(self.texts))
        most = np.minimum(common, (pairs + shorter + 1) / 2)
        return np.where(shorter > 0, 200.0 * most / np.maximum(shorter + most, 1), 100.0)

    def partial_ratios(self, candidate: str, rows: np.ndarray | None = None) -> np.ndarray:
        """Scores of the candidate against the texts at `rows` (default: all)."""
        rows = np.arange(len(self.texts)) if rows is None else np.asarray(rows, dtype=np.int64)
        self.scored += len(rows)
        m = len(candidate)
        out = np.zeros(len(rows))
        by_window = (self.lengths[rows] > m) if 0 < m <= WORD else np.zeros(len(rows), dtype=bool)
        for i in np.flatnonzero(~by_window):
            out[i] = partial_ratio(candidate, self.texts[rows[i]])
        todo = np.flatnonzero(by_window)
        if len(todo):
            bits = self._letter_bits(candidate)
            todo = todo[np.argsort(self.lengths[rows[todo]], kind="stable")]
            sizes = self.lengths[rows[todo]]
            start = 0
            while start < len(todo):
                part = slice(start, start + self.ROWS)
                fits = (np.arange(1, len(sizes[part]) + 1) * sizes[part] <= self.CELLS).sum()
                part = slice(start, start + max(1, int(fits)))
                out[todo[part]] = self._best_windows(bits, m, rows[todo[part]])
                start = part.stop
        return out

    def _letter_bits(self, candidate: str) -> np.ndarray:
        """Positions of each letter of the batch inside the candidate, as bit masks."""
        masks: dict[int, int] = {}
        for i, ch in enumerate(candidate):
            masks[ord(ch)] = masks.get(ord(ch), 0) | (1 << i)
        return np.array([masks.get(int(code), 0) for code in self.alphabet], dtype=np.uint64)

    def _best_windows(self, bits: np.ndarray, m: int, part: np.ndarray) -> np.ndarray:
        """Bit-parallel common subsequence over every window of every text of the part."""
        lengths = self.lengths[part][:, None]
        width = int(lengths.max())
        starts = np.arange(1 - m, width)
        masks = np.zeros((len(part), width + 2 * (m - 1)), dtype=np.uint64)
        body = masks[:, m - 1 : m - 1 + width]
        inside = np.arange(width) < lengths
        at = np.where(inside, self.starts[part][:, None] + np.arange(width), len(self.letters) - 1)
        np.take(bits, self.letters[at], out=body)
        body[~inside] = 0
        return _windows(masks, m, lengths)


class CandidateTree:
    """Distinct candidates by common beginnings, so that one step scores a beginning for all candidates that share it.

    `walk` follows, for each start in a text, the common subsequence of the beginning and the text from there on. Let d
    letters be read, and `lost` of them have no partner among the d letters from a start. A letter read later finds at
    most one partner, so a candidate of m letters has at most m - lost letters in common with the window of m letters,
    and a ratio of at most 100 (m - lost) / m. Letters that all candidates below still have to come and the text lacks
    count as read, and move the d letters from the start on by as many. A window cut at an end of the text is c letters shorter, has c <= lost
    and a ratio of at most 200 (m - lost) / (2m - lost). Both grow with m, so the longest candidate below a beginning
    gives the bound of all; where it misses the n-th best score so far, none below is looked at.
    """

    BEAM = 6  # beginnings per text and letter that the first walk follows; it only finds good scores early

    def __init__(self, candidates: list[str]):
        """Candidates of 1 to 64 letters; the same text may come more than once."""
        at: dict[str, list[int]] = {}
        for j, candidate in enumerate(candidates):
            at.setdefault(candidate, []).append(j)
        texts = sorted(at)
        self.members = [np.array(at[t], dtype=np.int64) for t in texts]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.width = int(lengths.max(initial=0))
        codes = _codes(texts, self.width)
        shared = np.zeros(len(texts), dtype=np.int64)
        shared[1:] = np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1).sum(axis=1)
        self.letters, self.longest, self.leaf, self.first, self.kids = [None], [None], [None], [], []
        self.known, places = np.unique(codes, return_inverse=True)
        self.known, places = self.known[self.known != _NO_LETTER], places.reshape(codes.shape)
        rest = np.zeros((len(texts), len(self.known) + 1), dtype=np.uint8)
        for column in places.T:
            rest[np.arange(len(texts)), column] += 1
        self.rest = [None]  # letters that all candidates below a node have after its beginning
        above = np.zeros(1, dtype=np.int64)
        for d in range(1, self.width + 1):
            heads = np.flatnonzero(shared < d)
            longest = np.maximum.reduceat(lengths, heads)
            rest[np.arange(len(texts)), places[:, d - 1]] -= 1
            self.rest.append(np.minimum.reduceat(rest[:, :-1], heads)[lengths[heads] >= d])
            heads, longest = heads[lengths[heads] >= d], longest[lengths[heads] >= d]
            kids = np.bincount(np.searchsorted(above, heads, side="right") - 1, minlength=len(above))
            self.kids.append(kids)
            self.first.append(np.cumsum(kids) - kids)
            self.letters.append(codes[heads, d - 1])
            self.longest.append(longest)
            self.leaf.append(np.where(lengths[heads] == d, heads, -1))
            above = heads
        self.kids.append(np.zeros(len(above), dtype=np.int64))
        self.first.append(np.zeros(len(above), dtype=np.int64))

    def best(self, block: TextBlock, n: int, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the best n candidates that are shorter than the text, for each text of the block."""
        top, pick = np.full((len(block.texts), n), -1.0), np.full((len(block.texts), n), -1, dtype=np.int64)
        # Letters by their number in the tree; those that no candidate holds share the last one.
        none = len(self.known)
        letters = np.append(self._numbers(block.alphabet)[block.letters[:-1]], none)
        steps = [None, *(self._numbers(codes) for codes in self.letters[1:])]
        rows = np.argsort(block.lengths, kind="stable")
        rows = rows[block.lengths[rows] > 1] if self.width else rows[:0]
        while len(rows):
            some = rows[: block.ROWS]
            cells = np.arange(1, len(some) + 1) * block.lengths[some] * (none + 1)
            part = some[: max(1, int((cells <= 4 * block.CELLS).sum()))]
            top[part], pick[part] = self._best_of_part(block, part, letters, steps, none, n, threshold, slack)
            rows = rows[len(part) :]
        return top, pick

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        return np.where(np.isin(codes, self.known), np.searchsorted(self.known, codes), len(self.known))

    def _best_of_part(self, block, part, letters, steps, none, n, threshold, slack):
        lengths, width = block.lengths[part], int(block.lengths[part].max())
        masks = np.zeros((len(part), none + 1, width), dtype=np.uint64)
        row, starts = np.arange(len(part))[:, None], np.arange(width)[None, :]
        for i in range(self.width):
            place = np.where(starts + i < lengths[:, None], block.starts[part][:, None] + starts + i, len(letters) - 1)
            masks[row, letters[place], starts] |= np.uint64(1 << i)
        masks[:, none] = 0
        counts = np.minimum(np.bitwise_count(masks & np.uint64(1)).sum(axis=2), WORD).astype(np.uint8)[:, :none]
        top, pick = np.full((len(part), n), -1.0), np.full((len(part), n), -1, dtype=np.int64)
        for beam in (self.BEAM, None):
            self._walk(block, masks, counts, lengths, steps, top, pick, threshold, slack, beam)
        return top, pick

    def _walk(self, block, masks, counts, lengths, steps, top, pick, threshold, slack, beam):
        width = masks.shape[2]
        starts = np.arange(width)
        texts = np.arange(len(lengths))
        todo = [(0, texts, np.zeros(len(texts), dtype=np.int64), np.full((len(texts), width), ~np.uint64(0)))]
        while todo:
            d, text, node, state = todo.pop()
            kids = self.kids[d][node]
            if kids.sum() * width > block.CELLS and len(text) > 1:
                half = len(text) // 2
                todo += [(d, text[half:], node[half:], state[half:]), (d, text[:half], node[:half], state[:half])]
                continue
            kids = np.where(lengths[text] > d + 1, kids, 0)
            source = np.repeat(np.arange(len(text)), kids)
            node = self.first[d][node][source] + np.arange(len(source)) - (np.cumsum(kids) - kids)[source]
            text, d = text[source], d + 1
            longest = np.minimum(self.longest[d][node], lengths[text] - 1)
            state = state[source]
            match = state & masks[text, steps[d][node]]
            state = (state + match) | (state - match)
            block.visited += len(text)
            needed, held = self.rest[d][node], counts[text]
            missing = (np.maximum(needed, held) - held).sum(axis=1)
            columns = ~np.uint64(0) >> (WORD - d - missing).astype(np.uint64)
            lost = np.bitwise_count(state & columns[:, None])
            least = lost.min(axis=1).astype(np.int64)
            cut = (starts == 0) | (starts > (lengths[text] - longest)[:, None])
            least_cut = np.maximum(np.where(cut, lost, WORD).min(axis=1).astype(np.int64), 1)
            bound = np.maximum(100.0 * (longest - least) / longest, 200.0 * (longest - least_cut) / np.maximum(2 * longest - least_cut, 1))
            hopeful = bound >= np.maximum(top[text, -1], threshold) - slack
            ends = np.flatnonzero(hopeful & (self.leaf[d][node] >= 0))
            if len(ends):
                block.scored += len(ends)
                scores = _ratios(state[ends], lost[ends], d, lengths[text[ends]])
                found = [self.members[j] for j in self.leaf[d][node[ends]]]
                sizes = [len(f) for f in found]
                keep_best(top, pick, np.repeat(text[ends], sizes), np.repeat(scores, sizes), np.concatenate(found))
            alive = np.flatnonzero(hopeful & (self.kids[d][node] > 0) & (bound >= np.maximum(top[text, -1], threshold) - slack))
            if beam is not None and len(alive):
                alive = alive[np.lexsort((least[alive], text[alive]))]
                heads = np.flatnonzero(np.append(True, text[alive][1:] != text[alive][:-1]))
                alive = alive[np.arange(len(alive)) - np.repeat(heads, np.diff(np.append(heads, len(alive)))) < beam]
            if len(alive):
                todo.append((d, text[alive], node[alive], state[alive]))


def _ratios(state: np.ndarray, lost: np.ndarray, m: int, lengths: np.ndarray) -> np.ndarray:
    """Best window of each row for a candidate of m letters, which its text exceeds; `state` has a column per start."""
    covered = np.minimum(lengths[:, None] - np.arange(state.shape[1]), m)
    common = m - lost.astype(np.int64)
    whole = np.where(covered > 0, 200.0 * common / (m + np.maximum(covered, 1)), 0.0).max(axis=1)
    cut = np.arange(1, m)
    ones = np.bitwise_count(state[:, :1] & (~np.uint64(0) >> (WORD - cut).astype(np.uint64))).astype(np.int64)
    return np.maximum(whole, (200.0 * (cut - ones) / (m + cut)).max(axis=1, initial=0.0))


def keep_best(top: np.ndarray, pick: np.ndarray, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
    """Merge found (row, score, place) into the best scores of each row, in place; ties go to the smaller place."""
    n = top.shape[1]
    touched = np.unique(rows)
    rows = np.concatenate([np.repeat(touched, n), rows])
    scores, places = np.concatenate([top[touched].ravel(), scores]), np.concatenate([pick[touched].ravel(), places])
    order = np.lexsort((places, -scores, rows))
    rows, scores, places = rows[order], scores[order], places[order]
    fresh = np.append(True, (rows[1:] != rows[:-1]) | (places[1:] != places[:-1]))
    rows, scores, places = rows[fresh], scores[fresh], places[fresh]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = rank < n
    top[touched], pick[touched] = -1.0, -1
    top[rows[kept], rank[kept]], pick[rows[kept], rank[kept]] = scores[kept], places[kept]


def _windows(masks: np.ndarray, m: int, lengths: np.ndarray) -> np.ndarray:
    """Best window of each row; `masks` hold the places of each letter in a text of m letters, m - 1 empty ones at both ends."""
    starts = np.arange(1 - m, masks.shape[1] - 2 * (m - 1))
    full = ~np.uint64(0) >> np.uint64(WORD - m)
    state = np.full((len(masks), len(starts)), full, dtype=np.uint64)
    for i in range(m):
        match = state & masks[:, i : i + len(starts)]
        rest = state - match
        state += match
        state |= rest
        state &= full
    common = m - np.bitwise_count(state).astype(np.int64)
    covered = np.minimum(starts + m, lengths) - np.maximum(starts, 0)
    return np.where(covered > 0, 200.0 * common / (m + np.maximum(covered, 1)), 0.0).max(axis=1)


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Letters of each text as a row of numbers, filled up by one that no letter has."""
    out = np.full((len(texts), width), _NO_LETTER, dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(width) < np.array([len(t) for t in texts])[:, None]] = flat
    return out


def pair_ratios(pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Partial ratio of each distinct pair; pairs of one shorter length are scored together."""
    out, by_length = {}, {}
    for a, b in set(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not short or len(short) > WORD or short in long:
            out[a, b] = partial_ratio(a, b)
            continue
        by_length.setdefault(len(short), []).append((short, long, (a, b)))
        if len(short) == len(long):
            by_length[len(short)].append((long, short, (a, b)))
    for m, entries in by_length.items():
        entries.sort(key=lambda e: len(e[1]))
        sizes = np.array([len(long) for _, long, _ in entries])
        start = 0
        while start < len(entries):
            some = sizes[start : start + TextBlock.ROWS]
            part = entries[start : start + max(1, int((np.arange(1, len(some) + 1) * some <= TextBlock.CELLS).sum()))]
            width = len(part[-1][1])
            short, long = _codes([e[0] for e in part], m), _codes([e[1] for e in part], width)
            masks = np.zeros((len(part), width + 2 * (m - 1)), dtype=np.uint64)
            for i in range(m):
                masks[:, m - 1 : m - 1 + width] |= (long == short[:, i : i + 1]).astype(np.uint64) << np.uint64(i)
            for (_, _, pair), score in zip(part, _windows(masks, m, sizes[start : start + len(part), None])):
                out[pair] = max(out.get(pair, 0.0), float(score))
            start += len(part)
    return out


def _postings(values: np.ndarray, owner: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each value the texts that hold it and how often."""
    if not len(values):
        return {}
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    heads = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
    times = np.diff(np.append(heads, len(values)))
    values, owner = values[heads], owner[heads]
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    ends = np.append(cuts[1:], len(values))
    return {int(values[i]): (owner[i:j], times[i:j]) for i, j in zip(cuts, ends)}


def _in_common(index: dict[int, tuple[np.ndarray, np.ndarray]], values: np.ndarray, n: int) -> np.ndarray:
    """Values that each text has in common with `values`, counted as often as both hold them."""
    out = np.zeros(n, dtype=np.int64)
    for value, times in zip(*np.unique(values, return_counts=True)):
        found = index.get(int(value))
        if found is not None:
            out[found[0]] += np.minimum(found[1], times)
    return out


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    found = pair_ratios([(x, y) for x, y in zip(a, b) if x is not None and y is not None])
    return pd.Series([None if x is None or y is None else found[x, y] for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def ascii_fold(names: pd.Series) -> pd.Series:
    """Lower, drop spaces and hyphens, then strip accents by NFKD."""

    def fold(name: str | None) -> str | None:
        if name is None:
            return None
        bare = name.lower().replace(" ", "").replace("-", "")
        return unicodedata.normalize("NFKD", bare).encode("ascii", "ignore").decode()

    return names.map(fold)
