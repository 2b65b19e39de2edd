"""Byte-level BPE by replaying the merges over all words of a slab of texts at once.

Texts are split into pieces by the tokenizer's pattern. All new pieces of a slab lie
end to end in one array of symbols. An inverted index leads from each mergeable pair,
named by its rank, to the places where it stands; merges are applied in rank order to
all places at once, and only the pairs with the two neighbours of a merged place are
looked up again. A piece that has been encoded is kept for later texts of the task.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import ragged, sent

SLAB_CHARS = 1_500_000
CACHED_PIECES = 300_000
LONG_PIECE = 8_192
NONE = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """Tokens by id (their rank), and the ids that adjacent ids merge into, by sorted pair."""

    tokens: list[bytes]
    pairs: np.ndarray
    merged: np.ndarray

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def bytes_to_id(self) -> np.ndarray:
        return np.array([self.ids[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes end to end, and their offsets."""
        return np.frombuffer(b"".join(self.tokens), np.uint8), np.r_[0, np.cumsum([len(t) for t in self.tokens])]

    @cached_property
    def settled(self) -> np.ndarray:
        """Whether no merge of a token with a neighbour comes before the merge that made it; then its places can be merged in any order."""
        left, right = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        out = np.ones(len(self.tokens), bool)
        out[left[self.merged < left]] = False
        out[right[self.merged < right]] = False
        return out

    @cached_property
    def merges(self) -> dict[int, int]:
        """Id that a pair of ids (the left one in the high half) merges into."""
        return dict(zip(self.pairs.tolist(), self.merged.tolist()))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's merge, or NONE."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)


def read_vocabulary(path: str) -> Vocabulary:
    """A rank file: one token in base64 and its rank per line, ranks 0, 1, ... without gaps."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    tokens = [t for _, t in ranked]
    ids = {t: i for i, t in enumerate(tokens)}
    if any(bytes([b]) not in ids for b in range(256)):
        raise ValueError("a byte-level vocabulary has all single bytes")
    found = sorted(
        (ids[t[:cut]] << 32 | ids[t[cut:]], i) for i, t in enumerate(tokens) for cut in range(1, len(t)) if t[:cut] in ids and t[cut:] in ids
    )
    return Vocabulary(tokens, np.array([k for k, _ in found], np.int64), np.array([i for _, i in found], np.int32))


def replay(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of non-empty pieces end to end, and the number of each piece's ids.

    Ranks come off a heap, lowest first. Where no merge can make a pair of still lower rank beside it, all places of the
    rank that do not overlap are merged in one step; else its first place in each piece, and the others wait. Pieces of more than
    LONG_PIECE bytes are replayed one by one.
    """
    if any(len(p) > LONG_PIECE for p in pieces):
        parts = [replay_long(vocabulary, p) if len(p) > LONG_PIECE else None for p in pieces]
        short = [p for p in pieces if len(p) <= LONG_PIECE]
        flat, counts = replay(vocabulary, short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        rest = iter(np.split(flat, np.cumsum(counts)[:-1]))
        ids = [next(rest) if part is None else part for part in parts]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
    lengths = np.array([len(p) for p in pieces], np.int64)
    total = int(lengths.sum())
    symbol = vocabulary.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    after = np.arange(1, total + 1, dtype=np.int64)
    after[np.cumsum(lengths) - 1] = -1
    before = np.arange(-1, total - 1, dtype=np.int64)
    before[np.cumsum(lengths) - lengths] = -1
    rank = np.full(total, NONE, np.int32)
    has = np.flatnonzero(after >= 0)
    rank[has] = vocabulary.rank(symbol[has], symbol[after[has]])
    alive = np.ones(total, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(places: np.ndarray) -> None:
        places = places[rank[places] != NONE]
        if len(places):
            places = places[np.argsort(rank[places], kind="stable")]
            own = rank[places]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, part in zip(own[np.r_[0, cuts]].tolist(), np.split(places, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(part)

    enter(has)
    while queue:
        r = heapq.heappop(queue)
        places = np.unique(np.concatenate(index.pop(r)))
        places = places[alive[places] & (rank[places] == r)]
        if not len(places):
            continue
        if vocabulary.settled[r]:
            chained = np.r_[False, after[places[:-1]] == places[1:]]
            number = np.arange(len(places))
            first = (number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0
            rest, at = places[:0], places[first]
        else:
            own = piece[places]
            first = np.r_[True, own[1:] != own[:-1]]
            rest, at = places[~first], places[first]
        gone = after[at]
        beyond = after[gone]
        symbol[at] = r
        alive[gone] = False
        rank[gone] = NONE
        after[at] = beyond
        more = beyond >= 0
        before[beyond[more]] = at[more]
        rank[at] = NONE
        rank[at[more]] = vocabulary.rank(symbol[at[more]], symbol[beyond[more]])
        prior = before[at]
        back = prior >= 0
        rank[prior[back]] = vocabulary.rank(symbol[prior[back]], symbol[at[back]])
        enter(np.concatenate([rest, at[more], prior[back]]))
    return symbol[alive], np.bincount(piece[alive], minlength=len(pieces))


def replay_long(vocabulary: Vocabulary, piece: bytes) -> np.ndarray:
    """Ids of one long piece: the pair of lowest rank, and of these the leftmost, comes off a heap until none is left."""
    merges, symbol = vocabulary.merges, vocabulary.bytes_to_id[np.frombuffer(piece, np.uint8)].tolist()
    size = len(symbol)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(m, i) for i in range(size - 1) if (m := merges.get(symbol[i] << 32 | symbol[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if symbol[i] < 0 or j >= size or merges.get(symbol[i] << 32 | symbol[j]) != r:
            continue
        symbol[i], symbol[j] = r, -1
        after[i] = k = after[j]
        if k < size:
            before[k] = i
            if (m := merges.get(r << 32 | symbol[k])) is not None:
                heapq.heappush(heap, (m, i))
        if (p := before[i]) >= 0 and (m := merges.get(symbol[p] << 32 | r)) is not None:
            heapq.heappush(heap, (m, p))
    return np.array([x for x in symbol if x >= 0], np.int32)


class _Pieces(dict):
    """Piece -> number; ``settle`` encodes the pieces that are new."""

    def __init__(self, vocabulary: Vocabulary):
        super().clear()
        self.vocabulary, self.fresh = vocabulary, []
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def clear(self) -> None:
        self.__init__(self.vocabulary)

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece.encode())
        return number

    def settle(self) -> None:
        if not self.fresh:
            return
        direct = np.array([self.vocabulary.ids.get(p, -1) for p in self.fresh], np.int32)
        merge = np.flatnonzero(direct < 0)
        ids, counts = replay(self.vocabulary, [self.fresh[i] for i in merge]) if len(merge) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        lengths = np.ones(len(direct), np.int64)
        lengths[merge] = counts
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        flat[starts[direct >= 0]] = direct[direct >= 0]
        flat[ragged(starts[merge], counts)] = ids
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.fresh = []


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of numbers: the listed stretches of ``flat`` end to end, and each row's length."""
    numbers = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    own = lengths[numbers]
    ends = np.cumsum([len(p) for p in parts])
    sums = np.concatenate([[0], np.cumsum(own)])
    return flat[ragged(starts[numbers], own)], np.diff(np.concatenate([[0], sums[ends]]))


def _encoded(texts: pa.Array, pieces: _Pieces, split) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids end to end and their number by row, for one slab of texts after the other."""
    start = 0
    while start < len(texts):
        rows, chars = [], 0
        while start < len(texts) and chars < SLAB_CHARS:
            text = texts[start].as_py() or ""
            found = split(text)
            rows.append(np.fromiter(map(pieces.__getitem__, found), np.int64, len(found)))
            chars += len(text) + 100
            start += 1
        pieces.settle()
        yield _gathered(pieces.flat, pieces.starts, pieces.lengths, rows)
        if len(pieces) > CACHED_PIECES:
            pieces.clear()


def _id_lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat, pa.int32()))


def _decoded(vocabulary: Vocabulary, flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Bytes of each row of ids, put together from the tokens' bytes."""
    content, offsets = vocabulary.table
    starts, own = offsets[:-1], np.diff(offsets)
    ids = flat.astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(own[ids])])
    ends = sums[np.concatenate([[0], np.cumsum(lengths)])]
    data = b"".join(content[ragged(starts[part], own[part])].tobytes() for part in np.array_split(ids, len(ids) // SLAB_CHARS + 1))
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with the token ids of the whole text (array of int).

    Null and empty texts have no ids. No special tokens: their strings are ordinary
    text. A column named ``ids_col`` is replaced; others stay as they are.
    """
    held = sent(docs.sparkSession, vocabulary)

    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, split = _Pieces(held()), regex.compile(pattern).findall
        for texts in batches:
            for flat, lengths in _encoded(texts, pieces, split):
                yield _id_lists(flat, lengths)

    return docs.withColumn(ids_col, F.arrow_udf(ids_of, "array<int>")(F.col(text_col)))


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """The rows with the bytes that the ids stand for; null ids give no bytes."""
    held = sent(tokens.sparkSession, vocabulary)

    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = held()
        for lists in batches:
            yield _decoded(vocabulary, lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))

    return tokens.withColumn(bytes_col, F.arrow_udf(bytes_of, "binary")(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass through Python: the rows with the ids and with the bytes that these stand for."""
    held = sent(docs.sparkSession, vocabulary)

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = held()
        pieces, split = _Pieces(vocabulary), regex.compile(pattern).findall
        for texts in batches:
            for flat, lengths in _encoded(texts, pieces, split):
                yield pa.StructArray.from_arrays([_id_lists(flat, lengths), _decoded(vocabulary, flat, lengths)], ["ids", "decoded"])

    told = docs.withColumn("_both", F.arrow_udf(both, "ids array<int>, decoded binary")(F.col(text_col)))
    return told.withColumns({ids_col: F.col("_both.ids"), bytes_col: F.col("_both.decoded")}).drop("_both")


def digests(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text_col: str = "text") -> DataFrame:
    """``_ids``, their number, the digest of the ids as decimal text joined by commas, and that of the decoded bytes.

    They stand beside the other columns; columns named ``_both``, ``_ids``, ``_decoded`` or as a result are replaced.
    """
    told = round_trip(docs, vocabulary, pattern, text_col, "_ids", "_decoded")
    return told.withColumns({
        "n_tokens": F.size("_ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("_ids").cast("array<string>"), ","), 256),
        "decoded_sha256": F.sha2("_decoded", 256),
    }).drop("_decoded")
