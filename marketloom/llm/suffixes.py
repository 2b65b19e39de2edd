"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

A window is a string of ``WINDOW`` bytes. Any window holds an anchor: the start of its ``GRAM``-byte string of
least hash, which depends on the window alone, so equal windows have their anchors
at equal places. Only suffixes that start at anchors are handled, and of these only
those whose leading string occurs more than once.

1. Anchors of all texts meet by hash; those that occur once drop out.
2. The suffixes at the others, with the bytes in front of them, are dealt to buckets by
   their leading bytes at sampled splitters. Equal leading bytes never straddle a boundary, so a bucket
   compares all of a string's occurrences.
3. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time. Equal ones
   lie side by side: all but the earliest repeat in full. The earliest ones of
   a leading string are compared window by window.
4. A leading string of very many occurrences goes to no bucket. Its windows, at most 77 a suffix, are dealt
   out by their hashes, and all but the earliest of a hash repeat.

Whole copies of a text of smaller id are settled by the text's hash beforehand. Before each exchange a task settles what it can see alone: of equal strings in one slab of
texts only the earliest travels, so a passage in every third document sends one row per slab.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import MIX, ragged, scramble, slabs, utf8
from marketloom.session import materialize, sized_broadcast

WINDOW = 100
GRAM = 24
LEFT = WINDOW - GRAM  # bytes in front of an anchor that its windows can reach
CONTEXT = LEFT + WINDOW
SLAB_BYTES = 1_500_000
SEGMENT = 4_000_000  # a longer text is looked through in overlapping segments
ROWS = 8192
HOT = 65_536  # a leading string of more occurrences is compared by the hashes of its windows
KNOWN, SUFFIX, WINDOWS = 0, 1, 2  # rows that need no comparison, suffixes, and windows of hot leading strings
LAST = np.uint64(2**64 - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling: 1, 2, 4, 8, 16 bytes, then 16 and 8 together."""
    h = scramble(np.arange(256, dtype=np.uint64) + MIX)[data]
    parts, n = {}, 1
    while n < 16:
        h = h[:-n] * np.uint64(pow(0xBF58476D1CE4E5B9, n, 1 << 64)) + h[n:]
        n *= 2
        parts[n] = h
    size = len(data) - GRAM + 1
    h = parts[16][:size] * np.uint64(pow(0xBF58476D1CE4E5B9, 8, 1 << 64)) + parts[8][16 : 16 + size]
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over each stretch of ``width`` values."""
    n, have = 1, values
    while n * 2 <= width:
        have = of(have[:-n], have[n:])
        n *= 2
    rest = width - n
    return of(have[: len(have) - rest], have[rest:]) if rest else have


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie within one of the texts."""
    lengths = np.diff(offsets)
    if not (lengths >= WINDOW).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.repeat(offsets[1:], lengths)
    size = len(data) - GRAM + 1
    h = gram_hashes(data)
    h[np.arange(size) + GRAM > end[:size]] = LAST
    width = WINDOW - GRAM + 1
    least = _sliding(h, width, np.minimum)
    least[np.arange(len(least)) + WINDOW > end[: len(least)]] = 0  # not a window
    pad = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((best == h) & (h != LAST))
    return at, h[at]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, place, hash) of anchors, slab by slab, as arrays of three rows; long texts by segments that overlap by a window."""
    for start, stop in slabs(np.diff(offsets), SLAB_BYTES):
        if offsets[stop] - offsets[start] <= SEGMENT:
            at, h = anchors(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
            doc = np.searchsorted(offsets, at + offsets[start], side="right") - 1
            yield np.stack([doc, at + offsets[start] - offsets[doc]]), h
        else:
            places, hashes = [], []
            for begin in range(int(offsets[start]), int(offsets[stop]), SEGMENT):
                own = data[begin : min(begin + SEGMENT + WINDOW - 1, int(offsets[stop]))]
                at, h = anchors(own, np.array([0, len(own)]))
                places.append(at + begin - offsets[start])
                hashes.append(h)
            at, once = np.unique(np.concatenate(places), return_index=True)
            yield np.stack([np.full(len(at), start), at]), np.concatenate(hashes)[once]


def _by_slot(slot: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[order], np.arange(count + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _ask_anchors(slots: int):
    """Rows (key, text) -> (slot, known, hashes, counts, keys, places): of equal anchors of a slab one asks, with their count; if there are more, all are known to repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for (doc, at), h in _pieces(data, offsets):
                _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                many = count[inverse] > 1
                out = [(s, False, h[first[i]].astype(np.int64), count[i], keys[doc[first[i]]], at[first[i]]) for s, i in _by_slot((h[first] >> np.uint64(32)) % np.uint64(slots), slots)]
                out += [(s, True, np.zeros(0, np.int64), np.zeros(0, np.int64), keys[doc[many][i]], at[many][i]) for s, i in _by_slot(doc[many] % slots, slots)]
                if out:
                    slot, known, hashes, counts, of, places = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot, pa.int32()), pa.array(known), _lists(list(hashes), pa.int64()), _lists(list(counts), pa.int32()), _lists(list(of), pa.int64()), _lists(list(places), pa.int32())],
                        ["slot", "known", "hashes", "counts", "keys", "places"],
                    )

    return work


def _per_key(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.r_[begin, len(keys)].astype(np.int32), [c[order] for c in columns]


def _answer_anchors(most: int):
    """-> (key, places, hot): anchors that were known or were asked for more than once; in rows without a key, hashes that occur over ``most`` times."""

    def told(keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        key, at, (places,) = _per_key(keys, places)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.ListArray.from_arrays(pa.array(at), pa.array(places, pa.int32())), _lists([np.zeros(0, np.int64)] * len(key), pa.int64())], ["key", "places", "hot"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            if known.any():
                own = batch.filter(pa.array(known))
                yield told(own.column("keys").flatten().to_numpy(), own.column("places").flatten().to_numpy())
            own = batch.filter(pa.array(~known))
            for column, name in zip(asked, ("hashes", "counts", "keys", "places")):
                column.append(own.column(name).flatten().to_numpy().copy())
        if not asked[0]:
            return
        h, counts, keys, places = (np.concatenate(c) for c in asked)
        order = np.argsort(h, kind="stable")
        s = h[order]
        again = np.zeros(len(s), bool)
        again[1:] = s[1:] == s[:-1]
        again[:-1] |= again[1:]
        again = order[again]
        if len(again):
            yield told(keys[again], places[again])
        begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        hot = s[begin[np.add.reduceat(counts[order].astype(np.int64), begin) > most]] if len(s) else s
        if len(hot):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), _lists([np.zeros(0, np.int32)], pa.int32()), _lists([hot], pa.int64())], ["key", "places", "hot"])

    return work


def _contexts(content: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes around each place of one text, plus one; 0 stands for none."""
    index = at[:, None] + np.arange(-LEFT, WINDOW)
    inside = (index >= 0) & (index < len(content))
    return np.where(inside, content[np.where(inside, index, 0)].astype(np.uint16) + 1, 0)


def _starts(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows that hold the anchor, within a text of ``size`` bytes."""
    return np.maximum(at - LEFT, 0), np.minimum(at, size - WINDOW)


def _powers(of: int) -> np.ndarray:
    return np.cumprod(np.r_[1, np.full(CONTEXT - 1, of, np.uint64)].astype(np.uint64))


def _leads(bytes_: np.ndarray) -> np.ndarray:
    """Rows of GRAM bytes as strings; numpy drops zeros at their end, so some different ones count as equal, but never the other way round."""
    return np.ascontiguousarray(bytes_).view(f"S{GRAM}").reshape(-1)


def _window_hashes(ctx: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes in front of the anchor, rows that have such a window, two hashes of each) for all windows that hold the anchors."""
    for start in range(0, len(at), ROWS):
        part = slice(start, start + ROWS)
        sums = np.zeros((2, len(at[part]), CONTEXT + 1), np.uint64)
        for own, of in zip(sums, (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)):
            np.cumsum((ctx[part].astype(np.uint64) + np.uint64(1)) * _powers(of), axis=1, out=own[:, 1:])
        low, high = _starts(at[part], size[part])
        for back in range(LEFT + 1):
            rows = np.flatnonzero((at[part] - back >= low) & (at[part] - back <= high))
            h = sums[:, rows, LEFT - back + WINDOW] - sums[:, rows, LEFT - back]
            yield back, rows + start, scramble(h + np.uint64(back + 1) * MIX).T


def _late_windows(h: np.ndarray, ords: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a window of the same two hashes has an earlier place."""
    order = np.lexsort((start, ords, h[:, 1], h[:, 0]))
    new = np.r_[True, (h[order][1:] != h[order][:-1]).any(1)] if len(order) else np.zeros(0, bool)
    origin = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    late = np.zeros(len(order), bool)
    late[order] = (ords[order] != ords[origin]) | (start[order] != start[origin])
    return late


def _ask_windows(ctx: np.ndarray, keys: np.ndarray, ords: np.ndarray, at: np.ndarray, size: np.ndarray, slots: int) -> Iterator[tuple]:
    """Rows of _ask_suffixes for suffixes of hot leading strings: of equal windows the earliest asks, the others are known to repeat."""
    found: list[list] = [[] for _ in range(LEFT + 1)]
    for back, rows, h in _window_hashes(ctx, at, size):
        found[back].append((rows, h))
    hit = np.zeros((len(at), LEFT + 3), np.int8)
    for back, parts in enumerate(found):
        rows, h = (np.concatenate(x) for x in zip(*parts))
        late = _late_windows(h, ords[rows], at[rows] - back)
        hit[rows[late], back + 1] = 1
        found[back] = [rows[~late], h[~late], at[rows[~late]] - back]
    rows, h, start = (np.concatenate(x) for x in zip(*found))
    for s, i in _by_slot(h[:, 0] % np.uint64(slots), slots):
        yield s, WINDOWS, keys[rows[i]], ords[rows[i]], start[i], np.zeros(0, np.int64), h[i].tobytes()
    edge = np.diff(hit, axis=1)
    (row, least), (_, beyond) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    for s, i in _by_slot(keys[row].view(np.uint64) % np.uint64(slots), slots):
        yield s, KNOWN, keys[row[i]], ords[row[i]], at[row[i]] - beyond[i] + 1, at[row[i]] - least[i], b""


def _ask_suffixes(slots: int, splitters: np.ndarray, hot: np.ndarray):
    """Rows (key, ord, text, places) -> (slot, kind, keys, ords, places, sizes, contexts).

    Known rows carry in ``places`` and ``sizes`` the first and last start of repeated windows, rows of
    windows in ``places`` their starts and in ``contexts`` their hashes. ``hot``: sorted hashes of the leading strings to compare by windows.
    """
    digits = _powers(0x9E3779B97F4A7C15)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys, ords = batch.column("key").to_numpy(), batch.column("ord").to_numpy()
            places = batch.column("places")
            for start, stop in slabs(places.value_lengths().to_numpy(zero_copy_only=False) * 176, 4_000_000):
                docs, ats, hashes = [], [], []
                for i in range(start, stop):
                    at = np.unique(places[i].values.to_numpy())
                    content = data[offsets[i] : offsets[i + 1]]
                    for a in range(0, len(at), ROWS):
                        hashes.append((_contexts(content, at[a : a + ROWS]).astype(np.uint64) * digits).sum(1, dtype=np.uint64))
                    docs.append(np.full(len(at), i))
                    ats.append(at)
                doc, at, h = np.concatenate(docs), np.concatenate(ats).astype(np.int64), np.concatenate(hashes)
                size = np.diff(offsets)[doc]
                order = np.lexsort((at, ords[doc]))
                doc, at, h, size = doc[order], at[order], h[order], size[order]
                _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                origin = first[inverse]
                late = (ords[doc] != ords[doc[origin]]) | (at != at[origin])
                rest, asks = np.flatnonzero(late), np.flatnonzero(~late)
                low, high = _starts(at[rest], size[rest])
                out = [(s, KNOWN, keys[doc[rest[i]]], ords[doc[rest[i]]], low[i], high[i], b"") for s, i in _by_slot(doc[rest] % slots, slots)]
                asks = asks[np.argsort(doc[asks], kind="stable")]
                own, begin = np.unique(doc[asks], return_index=True)
                content = np.concatenate([_contexts(data[offsets[d] : offsets[d + 1]], part) for d, part in zip(own, np.split(at[asks], begin[1:]))])
                whole = np.maximum(content.astype(np.int32) - 1, 0).astype(np.uint8)
                if len(hot) and len(asks):
                    grams = gram_hashes(whole[:, LEFT : LEFT + GRAM].reshape(-1))[::GRAM].astype(np.int64)
                    often = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
                    f = asks[often]
                    if len(f):
                        out += _ask_windows(whole[often], keys[doc[f]], ords[doc[f]], at[f], size[f], slots)
                    asks, whole = asks[~often], whole[~often]
                lead = _leads(whole[:, LEFT : LEFT + GRAM])
                sorted_by = np.argsort(lead, kind="stable")
                asks, whole, lead = asks[sorted_by], whole[sorted_by], lead[sorted_by]
                for s, i in _by_slot(np.searchsorted(splitters, lead, side="right"), slots):
                    f = asks[i]
                    out.append((s, SUFFIX, keys[doc[f]], ords[doc[f]], at[f], size[f], whole[i].tobytes()))
                for a in range(0, len(out), 20_000):
                    slot, kind, of, order_of, where, sizes, blobs = zip(*out[a : a + 20_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot, pa.int32()), pa.array(kind, pa.int32()), _lists(list(of), pa.int64()), _lists(list(order_of), pa.int64()), _lists(list(where), pa.int64()), _lists(list(sizes), pa.int64()), pa.array(blobs, pa.binary())],
                        ["slot", "kind", "keys", "ords", "places", "sizes", "contexts"],
                    )

    return work


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words, and the number of each sorted row's run of equal rows.

    Multikey quicksort over whole words: rows are sorted by one word, and only rows that tie go on to the next one.
    """
    order = np.arange(len(words))
    run = np.zeros(len(words), np.int64)
    tied = np.arange(len(words))
    for k in range(words.shape[1]):
        if not len(tied):
            break
        rows = order[tied]
        by = np.lexsort((words[rows, k], run[tied]))
        order[tied] = rows[by]
        own, word = run[tied], words[order[tied], k]
        new = np.r_[False, (own[1:] != own[:-1]) | (word[1:] != word[:-1])]
        start = np.zeros(len(words), bool)
        start[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])] = True
        start[tied[new]] = True
        run = np.cumsum(start) - 1
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1)
    return order, run


def _repeats(ctx: np.ndarray, keys: np.ndarray, ords: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, last start) of windows that stand at an earlier place, among suffixes with whole groups of equal leading strings."""
    n = len(at)
    left, right = np.minimum(at, LEFT), np.minimum(size - at, WINDOW)
    padded = np.zeros((n, 184), np.uint8)
    padded[:, :WINDOW] = ctx[:, LEFT:]
    padded[:, WINDOW:CONTEXT] = ctx[:, :LEFT]
    padded[:, CONTEXT], padded[:, CONTEXT + 1] = left, right
    words = padded.view(">u8").astype(np.uint64)
    order, run = multikey_order(words)
    # Within a run of equal suffixes the earliest comes first.
    order = order[np.lexsort((at[order], ords[order], run))]
    first = np.r_[True, run[1:] != run[:-1]]
    own_first = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    origin = order[own_first]
    rest = (ords[order] != ords[origin]) | (at[order] != at[origin])
    late = order[rest]
    low, high = _starts(at[late], size[late])
    out = [(keys[late], low, high)]
    heads = order[first]
    group = np.cumsum(np.r_[True, (words[heads][1:, :3] != words[heads][:-1, :3]).any(1)]) if len(heads) else np.zeros(0, np.int64)
    many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    heads, group = heads[many], group[many]
    if len(heads):
        by = np.lexsort((at[heads], ords[heads], group))
        heads, group = heads[by], group[by]
        digits = np.cumprod(np.r_[1, np.full(CONTEXT - 1, 0x9E3779B97F4A7C15, np.uint64)].astype(np.uint64))
        sums = np.zeros((len(heads), CONTEXT + 1), np.uint64)
        np.cumsum((ctx[heads].astype(np.uint64) + np.uint64(1)) * digits, axis=1, out=sums[:, 1:])
        hit = np.zeros((len(heads), LEFT + 1), bool)
        for back in range(LEFT + 1):
            ok = np.flatnonzero((back <= left[heads]) & (WINDOW - back <= right[heads]))
            h = sums[ok, LEFT - back + WINDOW] - sums[ok, LEFT - back]
            h = scramble(h ^ group[ok].astype(np.uint64) * MIX)
            seen = np.argsort(h, kind="stable")
            s = h[seen]
            new = np.r_[True, s[1:] != s[:-1]]
            source = seen[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))] if len(s) else seen
            a, b = heads[ok[seen]], heads[ok[source]]
            hit[ok[seen], back] = (ords[a] != ords[b]) | (at[a] != at[b])
        row, back = np.nonzero(hit)
        out.append((keys[heads[row]], at[heads[row]] - back, at[heads[row]] - back))
    return tuple(np.concatenate(x) for x in zip(*out))


def _merged(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """(key, lows, highs): stretches of starts per key, joined where they touch."""
    keep = low <= high
    keys, low, high = keys[keep], low[keep], high[keep]
    order = np.lexsort((low, keys))
    keys, low, high = keys[order], low[order], high[order]
    if len(keys):
        number = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
        top = np.maximum.accumulate(high + number * (1 << 40)) - number * (1 << 40)
        new = np.r_[True, (keys[1:] != keys[:-1]) | (low[1:] > top[:-1] + 1)]
        begin = np.flatnonzero(new)
        keys, low, high = keys[begin], low[begin], np.maximum.reduceat(high, begin)
    key, at, (low, high) = _per_key(keys, low, high)
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, pa.int64())) for x in (low, high)]
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *lists], ["key", "lows", "highs"])


def _answer_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """-> (key, lows, highs): starts of windows that stand at an earlier place, as stretches."""
    asked: list[list] = [[], [], [], [], []]
    windows: list[list] = [[], [], [], []]
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == KNOWN).any():
            own = batch.filter(pa.array(kind == KNOWN))
            yield _merged(*(own.column(c).flatten().to_numpy() for c in ("keys", "places", "sizes")))
        for which, columns, width in ((SUFFIX, asked, CONTEXT), (WINDOWS, windows, 16)):
            own = batch.filter(pa.array(kind == which))
            for column, name in zip(columns, ("keys", "ords", "places", "sizes")[: len(columns) - 1]):
                column.append(own.column(name).flatten().to_numpy().copy())
            columns[-1].append(np.frombuffer(b"".join(own.column("contexts").to_pylist()), np.uint8).reshape(-1, width))
    if not asked[0]:
        return
    keys, ords, start, h = (np.concatenate(c) for c in windows)
    del windows
    late = _late_windows(h.view(np.uint64), ords, start)
    yield _merged(keys[late], start[late], start[late])
    keys, ords, at, size, ctx = (np.concatenate(c) for c in asked)
    del asked
    lead = np.ascontiguousarray(ctx[:, LEFT : LEFT + GRAM]).view(">u8").astype(np.uint64)
    order, run = multikey_order(lead)
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[begin, len(run)])
    for a, b in slabs(counts, 4 * ROWS):
        rows = order[begin[a] : begin[b - 1] + counts[b - 1]]
        yield _merged(*_repeats(ctx[rows], keys[rows], ords[rows], at[rows], size[rows]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, lows, highs) -> (id, n_bytes, starts, ends, kept)."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        lows, highs = batch.column("lows"), batch.column("highs")
        for a, b in slabs(np.diff(offsets), 8_000_000):
            starts, ends, kept = [], [], []
            for i in range(a, b):
                own = data[offsets[i] : offsets[i + 1]]
                low, high = (np.asarray(x[i].as_py() or [], np.int64) for x in (lows, highs))
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, low, 1)
                np.add.at(change, high + WINDOW, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.diff(np.r_[False, gone, False].astype(np.int8))
                starts.append(np.flatnonzero(edge == 1))
                ends.append(np.flatnonzero(edge == -1))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), pa.array(np.diff(offsets)[a:b]), _lists(starts, pa.int64()), _lists(ends, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "starts", "ends", "kept"],
            )


def _splitters(read: DataFrame, slots: int, docs: int) -> np.ndarray:
    """Leading bytes that part a sample of suffixes into ``slots`` equal shares; the sample is about ``docs`` documents."""

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for (doc, at), _ in _pieces(data, offsets):
                at = at + offsets[doc]
                own = data[at[:: 1 + len(at) // 200_000, None] + np.arange(GRAM)]
                yield pa.RecordBatch.from_arrays([pa.array(_leads(own).tolist(), pa.binary())], ["lead"])

    total = read.count()
    sample = read.filter(F.pmod(F.xxhash64(F.lit("split"), "key"), F.lit(1_000_003)) < F.lit(1_000_003.0 * docs / max(total, 1)))
    seen = np.sort(np.array([bytes(r[0]) for r in sample.select("text").mapInArrow(leads, "lead binary").collect()], f"S{GRAM}"))
    return seen[np.arange(1, slots) * len(seen) // slots] if len(seen) else seen


def _copies(read: DataFrame) -> DataFrame:
    """(key, size) of texts that equal one of smaller id: all their windows repeat, and none is the earliest, so they need no suffixes."""
    hashed = read.select("key", "ord", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    hashed = materialize(hashed, "hashes")
    first = hashed.groupBy("hash").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("last > first").select("hash", "first")
    return materialize(hashed.join(first, "hash").filter("ord > first").select("key", "size").distinct(), "copies")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_docs: int = 1000, hot_rows: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes, spans (removed stretches, array of start and end), kept (remaining bytes).

    A byte goes if a window of 100 bytes that covers it also starts at an earlier place: in a row
    of smaller id, or further to the front in the same one. Null ids count as the largest id. Rows that share an id are one document to this
    order: of two windows at the same place in them neither is earlier. Null texts are
    empty; texts below 100 bytes stay whole; an empty table gives no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(
        F.xxhash64(F.lit("row"), id_col, text_col).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("ord"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    splitters = _splitters(read, slots, split_docs)
    copies = _copies(read)
    asks = read.select("key", "text").join(sized_broadcast(copies.select("key")), "key", "left_anti").mapInArrow(_ask_anchors(slots), "slot int, known boolean, hashes array<long>, counts array<int>, keys array<long>, places array<int>")
    found = asks.repartition("slot").mapInArrow(_answer_anchors(hot_rows), "key long, places array<int>, hot array<long>")
    places = materialize(found.groupBy("key").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("hot")).alias("hot")), "anchors")
    hot = np.sort(np.array([h for r in places.filter("key is null").select("hot").collect() for h in r["hot"]], np.int64))  # one in hot_rows anchors at most
    met = read.join(places.select("key", "places"), "key").select("key", "ord", "id", "text", "places")
    suffixes = met.mapInArrow(_ask_suffixes(slots, splitters, hot), "slot int, kind int, keys array<long>, ords array<long>, places array<long>, sizes array<long>, contexts binary")
    stretches = suffixes.repartition("slot").mapInArrow(_answer_suffixes, "key long, lows array<long>, highs array<long>")
    whole_copies = copies.filter(f"size >= {WINDOW}").select("key", F.array(F.lit(0).cast("long")).alias("lows"), F.array(F.col("size") - WINDOW).alias("highs"))
    stretches = stretches.unionByName(whole_copies).groupBy("key").agg(F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs"))
    whole = read.select("key", "ord", "id", "text").join(stretches, "key", "left").select("key", "ord", "id", "text", "lows", "highs")  # as above, so that the texts move once
    schema = f"id {read.schema['id'].dataType.simpleString()}, n_bytes long, starts array<long>, ends array<long>, kept binary"
    out = whole.mapInArrow(_cut, schema)
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x.starts.alias("start"), x.ends.alias("end")))
    return out.select(F.col("id").alias(id_col), "n_bytes", spans.alias("spans"), "kept")
