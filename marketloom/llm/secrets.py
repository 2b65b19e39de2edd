"""Secret scans over every version of every file, by a ledger of blobs.

A version's text is a blob, addressed by its SHA-256. The ledger holds which rule versions
have scanned which blob, and what they found. A scan reads a blob only for rule
versions that the ledger lacks; findings are joined back to all paths that ever held the blob.
All of it is SQL expressions: positions follow from the lengths of matches and of the gaps between them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, kept if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


# The patterns, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, group=2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
SPAN = "struct<start: bigint, number: int, kind: string, end: bigint>"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Matches of a rule, leftmost and without overlap, as (start, number, kind, end) in code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    told = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(whole)), lambda x: F.length(x)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("own"), F.transform(told, lambda x: F.length(x)).alias("told"))
    none = F.array().cast(f"array<{SPAN}>")

    def add(held: Column, step: Column) -> Column:
        start = held["at"] + step["gap"]
        found = F.struct(start.alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), (start + step["own"]).alias("end"))
        return F.struct((start + step["own"]).alias("at"), F.when(step["told"] >= rule.least, F.array_append(held["found"], found)).otherwise(held["found"]).alias("found"))

    walked = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), add)["found"]
    return F.when(text.rlike(rule.pattern), walked).otherwise(none)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """The blobs that some rule version has not scanned, with the names of those rules in ``due``."""
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn("due", names)
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    due = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("due", due).drop("seen").filter(F.size("due") > 0)


def scan(blobs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New rows of the ledger (blob, scanned, findings) for blobs (blob, text): one per blob with rules due, clean ones too."""
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(F.array_contains("due", r.name), spans(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return unseen(blobs, ledger, rules).select("blob", F.col("due").alias("scanned"), F.concat(*found).alias("findings"))


def scan_history(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, ledger_path: str | None = None) -> DataFrame:
    """One row per input row (a version at a path): id, blob, findings in the order of start, kind, end.

    With ``ledger_path`` the ledger there is read if it exists, and the new rows are added to it; a rule
    whose version rises is scanned anew and its older findings are left out. Null texts are empty.
    An empty table gives no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    old = None
    if ledger_path and _exists(spark, ledger_path):
        old = spark.read.parquet(ledger_path)
        old = materialize(old.join(versions.select("blob").distinct(), "blob", "left_semi"), "ledger")
    new = materialize(scan(blobs, old, rules), "scanned")
    if ledger_path:
        new.write.mode("append").parquet(ledger_path)
    rows = new if old is None else old.unionByName(new)
    current = [F.lit(r.name) for r in rules]
    order = {r.kind: i for i, r in enumerate(rules)}
    live = rows.withColumn("at", F.arrays_overlap("scanned", F.array(*current))).filter("at").select("blob", "scanned", F.explode("findings").alias("f"))
    # A finding counts if the rule version that made it is current: its ledger row names the version.
    names = F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.name))]), F.col("f.kind"))
    number = F.element_at(F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))]), F.col("f.kind"))
    live = live.filter(names.isNotNull() & F.array_contains("scanned", names)).withColumn("number", number)
    told = live.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("f.start", "number", "f.kind", "f.end"))).alias("findings"))
    return versions.select("id", "blob").join(told, "blob", "left").select(
        F.col("id").alias(id_col), "blob", F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings")
    )


def _exists(spark, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def listed(findings: Column) -> Column:
    """``kind:start:end`` of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
