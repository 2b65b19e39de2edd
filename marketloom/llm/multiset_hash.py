"""Document fingerprints as homomorphic multiset hashes of paragraphs.

Each paragraph is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors, every lane
modulo 2^30. The order of paragraphs does not count, and a fingerprint follows an edit by adding the vectors
of the paragraphs that came in and subtracting those of the ones that went (``plus`` and ``minus``), without a look at the rest.

A fingerprint is an array of longs: the number of paragraphs, 16 wide lanes that hold 30 bits of hash each, and
60 packed pairs of bit counts. The lanes of hash settle equality. A bit count says in how many paragraphs one bit of the hash is
set; centred, the 120 counts are a random projection of the multiset, so their cosine estimates how much two multisets share.
All of it is SQL expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import materialize, sized_broadcast

#: A paragraph: up to a line break or the end of a sentence, so that running text without breaks has several.
PARAGRAPH = r"[^.!?\x0A-\x0D]+[.!?]*|[.!?]+"
BITS = 30
LOW = (1 << BITS) - 1
PAIR = 1 << BITS | 1
WIDE = 16  # lanes of 30 bits of hash
COUNTS = 2 * BITS  # packed pairs of bit counts
WIDTH = 1 + WIDE + COUNTS
ORDER_ROWS = 200_000


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text without blanks at their ends, each as often as it stands there; blank ones count too."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.trim(p))


def _numbers(paragraph: Column) -> list[Column]:
    """Eight numbers of 60 bits from two SHA-256 hashes of a paragraph."""
    hashes = [F.sha2(paragraph, 256), F.sha2(F.concat(F.lit("+"), paragraph), 256)]
    return [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("long") for h in hashes for i in range(4)]


def summed(rows: DataFrame, keys: list[str], paragraph: str) -> DataFrame:
    """keys, ``vector``: the fingerprint of each group's paragraphs (one a row, null for none)."""
    names = [f"_h{i}" for i in range(8)]
    hashed = rows.select(*keys, F.col(paragraph).isNotNull().cast("long").alias("_n"), *[x.alias(name) for x, name in zip(_numbers(F.col(paragraph)), names)])
    wide = [F.sum(part) for name in names for part in (F.col(name).bitwiseAND(F.lit(LOW)), F.shiftright(name, BITS))]
    counts = [F.sum(F.shiftright(name, s).bitwiseAND(F.lit(PAIR))) for name in names[:2] for s in range(BITS)]
    lanes = {f"_l{i}": x for i, x in enumerate([F.sum("_n"), *wide, *counts])}
    sums = hashed.groupBy(*keys).agg(*[x.alias(name) for name, x in lanes.items()])
    told = [F.coalesce(F.col(name), F.lit(0).cast("long")) for name in lanes]
    return sums.select(*keys, F.array(*[x.bitwiseAND(F.lit(LOW)) if 0 < i <= WIDE else x for i, x in enumerate(told)]).alias("vector"))


def _lanes(a: Column, b: Column, sign: int) -> Column:
    """Sum or difference lane by lane, each of the two lanes of a number modulo 2^30."""

    def lane(x: Column, y: Column) -> Column:
        low = (x + F.lit(sign) * y).bitwiseAND(F.lit(LOW))
        high = (F.shiftright(x, BITS) + F.lit(sign) * F.shiftright(y, BITS)).bitwiseAND(F.lit(LOW))
        return F.shiftleft(high, BITS).bitwiseOR(low)

    return F.zip_with(a, b, lane)


def plus(a: Column, b: Column) -> Column:
    """Fingerprint of the multiset sum: ``b``'s paragraphs inserted into ``a``."""
    return _lanes(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` after ``b``'s paragraphs, which it holds, are deleted."""
    return _lanes(a, b, -1)


def text_of(vector: Column) -> Column:
    """Fingerprint as lowercase hexadecimal text of fixed length."""
    digits = lambda x, i: F.lpad(F.lower(F.hex(x)), F.when((i > 0) & (i <= WIDE), 8).otherwise(15), F.lit("0"))
    return F.array_join(F.transform(vector, digits), "")


def centred(vector: Column) -> Column:
    """The 120 bit counts, doubled and less the number of paragraphs: a sum of one +1 or -1 per paragraph and lane."""
    counts = F.slice(vector, 2 + WIDE, COUNTS)
    both = F.concat(F.transform(counts, lambda x: x.bitwiseAND(F.lit(LOW))), F.transform(counts, lambda x: F.shiftright(x, BITS)))
    return F.transform(both, lambda c: (F.lit(2) * c - F.element_at(vector, 1)).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda held, x: held + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two centred fingerprints, at least 0; 0 where one has no paragraphs."""
    size = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / size))).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the centred counts, at least 0.

    The cosine of the paragraphs' multiplicities is estimated with a standard error of about 0.09. An empty
    text is like nothing but an empty text.
    """
    return F.when(a == b, 1.0).otherwise(cosine(centred(a), centred(b)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, n_paragraphs, fingerprint (array) of the whole text.

    Null counts as empty; equal texts, and texts with the same paragraphs in another order, have equal
    fingerprints. Rows that repeat are summed apart. Only the named columns are read.
    """
    row = F.monotonically_increasing_id()
    named = materialize(docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "texts")
    pieces = named.select("_row", F.explode_outer(paragraphs(F.col("_text"))).alias("_p"))
    sums = summed(pieces, ["_row"], "_p")
    told = named.select("_row", "_id", F.length("_text").cast("long").alias("n_chars")).join(sums, "_row")
    return told.select(F.col("_id").alias(id_col), "n_chars", F.element_at("vector", 1).alias("n_paragraphs"), F.col("vector").alias("fingerprint"))


def in_order(groups: DataFrame) -> DataFrame:
    """Groups (key, id, ...) with ``next_key``: the group that follows by descending id (null last) and key; the first follows the last.

    Ids are dealt into ranges; a range is ordered by itself, and only its first group travels to the range before.
    """
    spark = groups.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(groups.count() / ORDER_ROWS))
    order = [F.desc_nulls_last("id"), F.asc("key")]
    laid = materialize(groups.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "order")
    inside = Window.partitionBy("range").orderBy(*order)
    laid = laid.withColumns({"follower": F.lead("key").over(inside), "place": F.row_number().over(inside)})
    # One row per range: as many as partitions, whatever the number of documents.
    along = Window.orderBy("range")
    firsts = laid.filter("place = 1").select("range", F.col("key").alias("first"))
    everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("range", F.coalesce(F.lead("first").over(along), F.first("first").over(everything)).alias("beyond"))
    joined = laid.join(sized_broadcast(materialize(heads, "heads")), "range")
    return joined.select(*groups.columns, F.coalesce("follower", "beyond").alias("next_key"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness to each other and to the next document.

    The edited text loses its last floor(n_chars / 2) code points and gets the first as many, or all, of the next
    document, by descending id; after the last comes the first. Its fingerprint is not summed anew: paragraphs in front of the
    edit stay, those behind it are deleted and the new ones inserted.

    Columns: id, n_chars, edited_sha256, vector, edited_vector, near_edited, near_next. Null texts are empty. Rows of one id
    follow each other by the hash of their texts, null ids come last; the next document of a repeated row is its repetition,
    and the last of them goes on to the next group. A single row is its own next document. An empty table gives no rows. Only the named
    columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.substring(F.sha2(text, 256), 1, 32))
    named = docs.select(key.alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    groups = materialize(named.groupBy("key", "id").agg(F.count(F.lit(1)).alias("copies"), F.first(F.length("text").cast("long")).alias("n_chars")), "groups")
    chain = materialize(in_order(groups), "chain")
    texts = named.select("key", "text")
    if chain.filter("copies > 1").limit(1).count():
        texts = texts.dropDuplicates(["key"])
    wanted = chain.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    heads = texts.join(wanted, "key").select(F.col("for_key").alias("key"), F.substring("text", F.lit(1), F.col("need")).alias("head"))
    own = texts.join(chain, "key").join(heads, "key")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    again = F.struct(F.lit(True).alias("again"), F.substring("text", F.lit(1), half).alias("head"), (F.col("copies") - 1).alias("times"))
    once = F.struct(F.lit(False).alias("again"), F.col("head"), F.lit(1).cast("long").alias("times"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    own = own.withColumn("edit", F.explode(F.when(F.col("copies") > 1, F.array(once, again)).otherwise(F.array(once))))
    own = own.select("key", "id", "n_chars", "text", "edit.again", "edit.times", kept.alias("kept"), F.concat(kept, F.col("edit.head")).alias("edited"))
    # The last paragraph of the kept half may go on in either text; those before it are in both.
    stay = F.greatest(F.size(paragraphs(F.col("kept"))) - 1, F.lit(0))
    keys = ["key", "id", "n_chars", "again", "times", "edited_sha256"]
    split = own.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, paragraphs(F.col("text")).alias("old"), paragraphs(F.col("edited")).alias("new"), stay.alias("stay"))
    tagged = lambda ps, part: F.transform(ps, lambda p: F.struct(F.lit(part).alias("part"), p.alias("p")))
    behind = lambda name: F.slice(name, F.col("stay") + 1, F.greatest(F.size(name) - F.col("stay"), F.lit(0)))
    parts = F.concat(tagged(F.slice("old", F.lit(1), F.col("stay")), 0), tagged(behind("old"), 1), tagged(behind("new"), 2))
    rows = split.select(*keys, F.explode_outer(parts).alias("_x")).select(*keys, F.coalesce("_x.part", F.lit(0)).alias("part"), "_x.p")
    sums = summed(rows, [*keys, "part"], "p").groupBy(*keys).agg(F.collect_list(F.struct("part", "vector")).alias("parts"))
    none = F.array_repeat(F.lit(0).cast("long"), WIDTH)
    of = lambda part: F.coalesce(F.get(F.filter("parts", lambda x: x["part"] == part), F.lit(0))["vector"], none)
    told = sums.withColumn("gone", of(1)).withColumn("vector", plus(of(0), F.col("gone")))
    told = told.withColumn("edited_vector", plus(minus(F.col("vector"), F.col("gone")), of(2))).drop("parts", "gone")
    # Texts and edits lie by key, so only the next documents' sums travel.
    others = summed(texts.join(wanted, "key").select("key", "for_key", F.explode_outer(paragraphs(F.col("text"))).alias("p")), ["key", "for_key"], "p")
    met = told.join(others.select(F.col("for_key").alias("key"), F.col("vector").alias("other")), "key")
    met = met.withColumn("other", F.when(F.col("again"), F.col("vector")).otherwise(F.col("other")))
    met = met.withColumns({f"{c}_centred": centred(F.col(c)) for c in ("vector", "edited_vector", "other")})
    near = lambda c: F.when(F.col("vector") == F.col(c), 1.0).otherwise(cosine(F.col("vector_centred"), F.col(f"{c}_centred")))
    done = met.withColumns({"near_edited": near("edited_vector"), "near_next": near("other")})
    done = done.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return done.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "vector", "edited_vector", "near_edited", "near_next")
