"""Mixing sources to target weights by hash-random keys, range prefix sums and exact cuts.

Every document gets a random key from a hash of its id. Within a source, documents
are laid out in key order; the mix takes whole rounds of a source and then the
documents of the last round up to the word at which the source's budget is spent.
The order is never gathered: keys fall into ranges, ranges are summed, and only
the sums of ranges are added up along a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize, sized_broadcast

WORD = r"[^\x20\x09-\x0D]+"
KEY_SPACE = 1 << 32


def word_count(text_col: str):
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3) -> DataFrame:
    """Target words of each source: (source, source_size) -> source, source_size, target.

    Sources ordered by code point, null last, take the weights in turn and share
    the words of all. No target exceeds ``most_times`` its source; the excess goes to
    the others by weight. Sources reach their limit in order of limit over weight,
    so the share per weight is that of the first source that stays below. One row per
    source is ordered in one task; a table of sources is small beside its documents.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    ranked = sizes.withColumn("sid", F.row_number().over(order))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * most_times)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    filled = ranked.withColumn("left", left).withColumn("shares", F.sum("weight").over(after))
    below = F.col("left").cast("decimal(19,0)") * F.col("weight").cast("decimal(5,0)") <= (F.col("limit").cast("decimal(19,0)") * F.col("shares").cast("decimal(18,0)")).cast(wide)
    first = F.first(F.when(below, F.struct("left", "shares")), ignorenulls=True).over(everything)
    filled = filled.withColumn("below", below).withColumn("level", first)
    target = F.when(F.col("below"), (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.shares").cast("double")).otherwise(F.col("limit").cast("double"))
    return filled.select("source", "sid", "source_size", target.alias("target"))


def mix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_times: int = 3, seed: str = "mix", range_rows: int = 50_000) -> DataFrame:
    """Rows of one source, id and size as one row: their number ``copies`` and where they lie in the source's order.

    Columns: id, source, size, copies, source_size, target, budget (whole words of the target) and start (words of the
    source in front of the first of them). Repeated rows are counted before anything moves, so they cannot crowd a range.
    """
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), key.alias("key"))
    base = materialize(base.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    words = F.col("size") * F.col("copies")
    plan = materialize(targets(base.groupBy("source").agg(F.sum(words).alias("source_size"), F.count(F.lit(1)).alias("rows")).select("source", "source_size"), weights, most_times), "targets")
    counts = base.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    plan = materialize(plan.alias("p").join(counts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source"))).select("p.*", "c.rows"), "plan")
    side = sized_broadcast(plan.withColumnRenamed("source", "named"))
    placed = base.join(side, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranges = F.ceil(F.col("rows") / range_rows).cast("long")
    placed = placed.withColumn("range", F.floor(at * ranges / F.lit(KEY_SPACE)).cast("long"))
    sums = placed.groupBy("sid", "range").agg(F.sum(words).alias("words"))
    along = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "range", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(offsets, ["sid", "range"])
    return laid.select("id", "source", "size", "copies", "source_size", "target", F.floor("target").cast("long").alias("budget"), (F.col("offset") + F.col("inside")).alias("start"))


def _taken(number: str, size: str = "size"):
    """Words that the mix takes of the number-th row of a group."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - rounds * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col(size), rest - F.col("start") - F.col(number) * F.col(size)))
    return (rounds * F.col(size) + part).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words that the mix takes, repeats counted).

    A source's taken words add up to its target, rounded down. Null and empty texts
    have size 0 and are never taken; a null source is a source of its own; rows that
    repeat stand side by side in the order. An empty table gives no rows. Only the
    named columns are read.
    """
    groups = mix_groups(docs, id_col, text_col, source_col, **options)
    rows = groups.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _taken("number").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: documents with all their columns, once for each round that takes them.

    The document in which a source's budget ends is cut after its last taken word.
    """
    groups = materialize(mix_groups(docs, id_col, text_col, source_col, **options), "mix").select(
        F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies", "source_size", "budget", "start"
    )
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_of"), F.col(source_col).alias("_from"), word_count(text_col).alias("_words"))
    same = F.col("_of").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    met = named.join(groups.filter("_size > 0"), same)
    lone = met.filter("copies = 1").withColumn("number", F.lit(0).cast("long"))
    if groups.filter("copies > 1").limit(1).count():
        ties = Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64("_row"))
        lone = lone.unionByName(met.filter("copies > 1").withColumn("number", (F.row_number().over(ties) - 1).cast("long")))
    told = lone.withColumn("_taken", _taken("number", "_size")).filter("_taken > 0")
    times = F.ceil(F.col("_taken") / F.col("_size")).cast("long")
    told = told.withColumn("_round", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    told = told.withColumn("_part", F.least(F.col("_size"), F.col("_taken") - (F.col("_round") - 1) * F.col("_size")).cast("int"))
    pieces = F.regexp_extract_all(F.col(f"_row.`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(F.col("_part") == F.col("_size"), F.col(f"_row.`{text_col}`")).otherwise(F.array_join(F.slice(pieces, 1, F.col("_part")), ""))
    return told.select(*[cut.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
