"""Set similarity join on word shingles by chosen paths.

In every run a set picks each of its tokens with probability 1 / (threshold * size), by a
hash of run and token; sets that pick the same token share a bucket. A similar pair
shares a pick of one run with probability of about 1 - 1 / e or more, so runs are
repeated until the chance to miss a pair falls below one minus the target recall.
Buckets that are too large split again on tokens picked by a hash of the path so far,
unless most of their members are alike: splitting would not part them, so these are compared block by block. Small
buckets are compared by brute force: first by sketches, whose margin
keeps pairs at the threshold, then exactly, on the shingles of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import MIX, components, scramble, slabs, utf8
from marketloom.session import materialize, sized_broadcast

SKETCH = 64  # bytes; a pair at 0.8 agrees on 51 of them on average, with a deviation of 3.2
AGREE = 36  # nearly five deviations below
BUCKET = 32_768
WHOLE = 4096  # members of a bucket that are compared in one piece; a larger bucket is compared by blocks of them
DENSE_SHARE = 0.25  # of a large bucket's members that are like its first one
DEEPER = 3.0  # picks of a set per level, over 1 / threshold, below the first level
LEVELS = 4
BLOCK = 2048  # members of a group whose texts are compared in one piece
SLAB_BYTES = 1_500_000
CELLS = 4_000_000  # cells of a member-by-token matrix

# Fixed value: the white space at which words end, as str.split knows it within ASCII.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text end to end, sorted within it, and the row of each.

    A shingle is ``words`` adjacent words; a text of fewer words is one shingle of all of
    them, and a text without words has none.
    """
    lengths = np.diff(offsets)
    row_of_byte = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (row_of_byte[1:] != row_of_byte[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (row_of_byte[1:] != row_of_byte[:-1])
    ends = np.flatnonzero(last) + 1
    # A word's hash: its bytes as digits from its end, as a sum that wraps, then scrambled.
    place = (np.repeat(ends, ends - starts) - 1 - np.flatnonzero(inside)).astype(np.int64)
    powers = np.concatenate([[1], np.cumprod(np.full(int(place.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))]).astype(np.uint64)
    digits = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    word = scramble(np.add.reduceat(digits, np.cumsum(ends - starts) - (ends - starts)) + (ends - starts).astype(np.uint64))
    row = row_of_byte[starts]
    count = np.bincount(row, minlength=len(lengths))
    begin = np.cumsum(count) - count
    short = count < words
    kept = np.arange(len(word)) - begin[row] + words <= count[row]
    kept |= short[row] & (np.arange(len(word)) == begin[row])
    at = np.flatnonzero(kept)
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = at + k < (begin + count)[row[at]]
        h = np.where(there, scramble((h + word[np.minimum(at + k, len(word) - 1)]) * MIX), h)
    owner = row[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    return h[new], owner[new]


def _picks(tokens: np.ndarray, sizes: np.ndarray, path: np.ndarray, rate: float) -> np.ndarray:
    """Which tokens a path picks: those whose hash lies below rate / size of the set."""
    chance = np.minimum(rate / np.maximum(sizes, 1), 1.0)
    return (scramble(tokens ^ path) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < chance


def _sketches(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One byte of the smallest hash of each set under each of SKETCH functions."""
    out = np.empty((len(starts), SKETCH), np.uint8)
    seeds = scramble(np.arange(1, SKETCH + 1, dtype=np.uint64) * MIX)
    for k, seed in enumerate(seeds):
        mixed = (tokens ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = (np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts) * MIX >> np.uint64(56)).astype(np.uint8)
    return out


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has been met with this probability: each run meets it e ** -1 short of surely."""
    return max(1, math.ceil(-math.log(1.0 - recall)))


def _signatures(words: int, threshold: float, runs: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = scramble(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for start, stop in slabs(np.diff(offsets), SLAB_BYTES):
                tokens, owner = shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], words)
                n = np.bincount(owner, minlength=stop - start)
                full = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[full]
                node = np.zeros(stop - start, np.uint64)
                sketch = np.zeros((stop - start, SKETCH), np.uint8)
                paths, path_owner = [], []
                if len(full):
                    node[full] = scramble(np.add.reduceat(scramble(tokens * MIX), begin) + n[full].astype(np.uint64))
                    sketch[full] = _sketches(tokens, begin)
                    for seed in seeds:
                        hit = np.flatnonzero(_picks(tokens, n[owner], seed, 1.0 / threshold))
                        paths.append(scramble(tokens[hit] * MIX ^ seed))
                        path_owner.append(owner[hit])
                path, of = (np.concatenate(paths), np.concatenate(path_owner)) if paths else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                path = path[np.argsort(of, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=stop - start))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(start, stop - start),
                        batch.column("key").slice(start, stop - start),
                        pa.array(node.astype(np.int64), mask=n == 0),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(path.astype(np.int64))),
                        pa.array([r.tobytes() for r in sketch], pa.binary()),
                    ],
                    ["doc", "key", "node", "n", "paths", "sketch"],
                )

    return work


def _deeper(words: int, threshold: float):
    """Rows (text, node, paths) -> rows (node, path) of the next level."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            nodes, paths = batch.column("node").to_numpy(), batch.column("paths").to_pylist()
            for start, stop in slabs(np.diff(offsets), SLAB_BYTES):
                tokens, owner = shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], words)
                n = np.bincount(owner, minlength=stop - start)
                begin = np.cumsum(n) - n
                out_node, out_path = [], []
                for i in range(stop - start):
                    own = tokens[begin[i] : begin[i] + n[i]]
                    for path in paths[start + i]:
                        seed = scramble(np.array([path], np.int64).astype(np.uint64) + MIX)
                        hit = own[_picks(own, n[i], seed, DEEPER / threshold)]
                        out_path.append(scramble(hit * MIX ^ seed))
                        out_node.append(np.full(len(hit), nodes[start + i], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node or [np.zeros(0, np.int64)])), pa.array(np.concatenate(out_path or [np.zeros(0, np.uint64)]).astype(np.int64))], ["node", "path"])

    return work


def _runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from rows sorted by the keys; groups may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held:
            tail = held[-1]
            if any(tail.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _least_labels(near: np.ndarray) -> np.ndarray:
    """Smallest index of each member's component, for groups of one size: near is (groups, m, m)."""
    groups, m = near.shape[:2]
    labels = np.broadcast_to(np.arange(m, dtype=np.int32), near.shape[:2]).copy()
    step = max(1, CELLS // (groups * m))
    while True:
        after = np.concatenate([np.where(near[:, a : a + step], labels[:, None, :], np.int32(m)).min(2) for a in range(0, m, step)], 1)
        after = np.minimum(after, labels)
        after = np.take_along_axis(after, after, 1)
        if (after == labels).all():
            return labels
        labels = after


def _compare_buckets(threshold: float, keys: list[str]):
    """Rows (keys, node, n, sketch) by bucket -> (node, center): a member and the least of those it hangs together with."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, keys):
            table = table.combine_chunks()
            change = np.zeros(table.num_rows, bool)
            for k in keys:
                c = table.column(k).to_numpy()
                change[1:] |= c[1:] != c[:-1]
            begin = np.flatnonzero(np.r_[True, change[1:]])
            size = np.diff(np.r_[begin, table.num_rows])
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            nodes, centers = [], []
            for m in np.unique(size[size > 1]):
                group = begin[size == m]
                for part in np.array_split(group, max(1, math.ceil(len(group) * int(m) ** 2 / 200_000))):
                    if not len(part):
                        continue
                    rows = part[:, None] + np.arange(m)
                    rows = np.take_along_axis(rows, np.argsort(node[rows], 1), 1)
                    own, sizes = sketch[rows], n[rows]
                    near = np.zeros((len(part), m, m), bool)
                    for at in range(0, m, max(1, 200_000 // max(1, int(m) * len(part)))):
                        to = at + max(1, 200_000 // max(1, int(m) * len(part)))
                        same = (own[:, at:to, None, :] == own[:, None, :, :]).sum(3)
                        less, more = np.minimum(sizes[:, at:to, None], sizes[:, None, :]), np.maximum(sizes[:, at:to, None], sizes[:, None, :])
                        near[:, at:to] = (same >= AGREE) & (less >= threshold * more - 1e-9)
                    near &= ~np.eye(m, dtype=bool)
                    linked = near.any(2)
                    label = np.take_along_axis(rows, _least_labels(near), 1)
                    nodes.append(node[rows[linked]])
                    centers.append(node[label[linked]])
            if nodes:
                pairs = np.unique(np.stack([np.concatenate(nodes), np.concatenate(centers)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["node", "center"])

    return work


def _shared(tokens: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """How many tokens each two of m sets share; tokens of one set only take no part."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1
    number, owner = number[often], owner[often]
    out = np.zeros((m, m), np.float32)
    if not len(number):
        return out
    number = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1
    width = max(1, CELLS // m)
    for at in range(0, int(number[-1]) + 1, width):
        lo, hi = np.searchsorted(number, [at, at + width])
        cells = np.zeros((m, min(width, int(number[-1]) + 1 - at)), np.float32)
        cells[owner[lo:hi], number[lo:hi] - at] = 1
        out += cells @ cells.T
    return out


def _verify(words: int, threshold: float):
    """Rows (center, left, right, block, node, copies, centers, text) by group -> (node, links, root).

    A pair counts in the least of the groups that hold both, and there in one pair of blocks.
    """
    keys = ["center", "left", "right"]

    def group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = table.column("node").to_numpy()
        first = np.unique(node, return_index=True)[1]  # one text for each node
        center = table.column("center")[0].as_py()
        column = table.column("text").combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        data, offsets = utf8(column)
        tokens, owner = [], []
        for start, stop in slabs(np.diff(offsets), SLAB_BYTES):
            t, o = shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], words)
            tokens.append(t)
            owner.append(o + start)
        token, of = np.concatenate(tokens), np.concatenate(owner)
        rank = np.full(len(node), -1)
        rank[first] = np.arange(len(first))
        keep = rank[of] >= 0
        token, of = token[keep], rank[of[keep]]
        node, m = node[first], len(first)
        copies, block = table.column("copies").to_numpy()[first], table.column("block").to_numpy()[first]
        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        n = np.bincount(of, minlength=m).astype(np.float64)
        both = _shared(token, of, m)
        near = both * (1 + threshold) >= threshold * (n[:, None] + n[None, :]) - 1e-6
        near &= ~np.eye(m, dtype=bool)
        if left != right:
            near &= block[:, None] != block[None, :]
        lists = table.column("centers").to_pylist()
        less = [(i, c) for i, row in enumerate(first.tolist()) for c in lists[row] if c < center]
        if less:
            near &= _shared(np.array([c for _, c in less], np.int64).astype(np.uint64), np.array([i for i, _ in less]), m) == 0
        return node, near @ copies.astype(np.float64), node[_least_labels(near[None])[0]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, keys):
            columns = np.stack([table.column(k).to_numpy() for k in keys], 1)
            begin = np.flatnonzero(np.r_[True, (columns[1:] != columns[:-1]).any(1)])
            found = [group(table.slice(a, b - a)) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows])]
            node, links, root = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(links.astype(np.int64)), pa.array(root.astype(np.int64))], ["node", "links", "root"])

    return work


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _links(told: DataFrame, nodes: DataFrame, read: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, center) of all members that a bucket holds together with another one."""
    with_text = lambda rows: read.join(sized_broadcast(materialize(rows.join(nodes.select("node", "key"), "node"), "deeper")), "key")
    members = told
    found: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        members = materialize(members.distinct(), "members") if level > 1 else members
        sizes = materialize(members.groupBy("path").count().filter("count > 1"), "buckets")
        large = sizes.filter(F.col("count") > BUCKET)
        split = None
        if level < LEVELS and large.limit(1).count():
            split = materialize(_sparse(members, large, nodes), "split")
            sizes = sizes.join(split, "path", "left_anti")
        # What does not split is compared here, large buckets block by block, so that none is left out.
        rows = _in_blocks(members.join(sizes, "path").join(nodes.select("node", "n", "sketch"), "node"), F.col("count"), WHOLE)
        keys = ["path", "left", "right"]
        got = _sorted_by(rows.select(*keys, "node", "n", "sketch"), *keys).mapInArrow(_compare_buckets(threshold, keys), "node long, center long")
        got = materialize(got.distinct(), "near")
        found = got if found is None else found.union(got)
        if split is None or not split.limit(1).count():
            return found
        paths = members.join(split, "path").groupBy("node").agg(F.collect_list("path").alias("paths"))
        members = with_text(paths).select("text", "node", "paths").mapInArrow(_deeper(words, threshold), "node long, path long")
    return materialize(found.distinct(), "near")


def _sparse(members: DataFrame, large: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the large buckets (path), those in which few members are like the first one."""
    rows = members.join(large.select("path"), "path").join(nodes.select("node", "sketch"), "node")
    first = rows.groupBy("path").agg(F.min_by("sketch", "node").alias("first"))

    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, SKETCH) for x in (a, b))
        return pa.array((left == right).sum(1) >= AGREE)

    like = F.arrow_udf(alike, "boolean")("sketch", "first")
    share = rows.join(first, "path").groupBy("path").agg(F.avg(like.cast("int")).alias("share"))
    return share.filter(F.col("share") < DENSE_SHARE).select("path")


def _in_blocks(rows: DataFrame, size, block: int) -> DataFrame:
    """Each row once for every pair of blocks (left <= right) that its own block is part of."""
    number = F.ceil(size / block).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), number).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, text); the key tells rows apart that share an id or have none."""
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.lit("row"), id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, recall: float) -> DataFrame:
    """(doc, key, n, node, label, class_id, n_links) of every row; node and label are null without shingles."""
    read = _keyed(docs, id_col, text_col)
    schema = f"doc {read.schema['doc'].dataType.simpleString()}, key long, node long, n long, paths array<long>, sketch binary"
    signed = materialize(read.mapInArrow(_signatures(words, threshold, runs_for(recall)), schema), "signatures")
    per_node = signed.filter("node is not null").groupBy("node")
    nodes = materialize(per_node.agg(F.min("doc").alias("rep"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), "nodes")
    near = _links(nodes.select("node", F.explode("paths").alias("path")), nodes, read.select("key", "text"), words, threshold)
    up = near.groupBy(F.col("node").alias("center")).agg(F.min("center").alias("up"))  # centers of centers: fewer groups, so that fewer copies of a text travel
    near = materialize(near.join(up, "center", "left").select("node", F.coalesce("up", "center").alias("center")).distinct(), "groups")
    size = near.groupBy("center").count()
    centers = near.groupBy("node").agg(F.sort_array(F.collect_set("center")).alias("centers"))
    rows = near.join(size, "center").join(centers.join(nodes.select("node", "key", "copies"), "node"), "node")
    rows = read.select("key", "text").join(sized_broadcast(materialize(rows, "verify")), "key")
    rows = _in_blocks(rows, F.col("count"), BLOCK).select("center", "left", "right", "block", "node", "copies", "centers", "text")
    keys = ["center", "left", "right"]
    verified = materialize(_sorted_by(rows, *keys).mapInArrow(_verify(words, threshold), "node long, links long, root long"), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(verified.filter("root != node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classed = nodes.select("node", "rep", "copies").join(labels, "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classed.groupBy("label").agg(F.min("rep").alias("class_id"))
    classed = classed.join(least, "label").select("node", "label", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc", "key", "node", "n").join(classed, "node", "left")


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.999995) -> DataFrame:
    """One row per input row: id, class_id (least id of its class), n_links (other rows at or above the threshold), n_shingles.

    Rows with the same set of shingles are one node of the join and count by their
    number; classes are the components of links. Null texts and texts without words have
    no shingles, no links and a class of their own. Only the named columns are read;
    an empty table gives no rows. Rows with a null id take part; the class of nulls alone is null.
    """
    told = _classes(docs, id_col, text_col, words, threshold, recall)
    own = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("class_id"))
    return told.select(F.col("doc").alias(id_col), own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.999995) -> DataFrame:
    """Of each class of ``similarity_join`` the row with the least id, nulls last, with all its columns.

    Rows without words all stay. Of rows that share id and text one stays.
    """
    told = materialize(_classes(docs, id_col, text_col, words, threshold, recall).select("doc", "key", "label"), "classes")
    best = told.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col("key"))).alias("least")).select("least.key")
    rows = told.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.first("label").isNull().alias("_empty"))
    stay = materialize(rows.join(best, "key", "left_semi").union(rows.filter("_empty")).withColumnRenamed("key", "_key"), "stay")
    named = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.lit("row"), id_col, text_col).alias("_key"))
    met = named.join(stay, "_key")
    single = met.filter("_rows = 1 or _empty").select("_row.*")
    if not stay.filter("_rows > 1 and not _empty").limit(1).count():
        return single
    tied = met.filter("_rows > 1 and not _empty").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return single.unionByName(tied.select("_row.*"))
