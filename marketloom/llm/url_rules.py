"""URL filters: given rules, and association rules mined from the URLs they judge.

A given rule names a host and the beginning of a path. URLs that no rule fits are judged
by combinations of URL tokens that FP-growth finds frequent among the labelled URLs and
that almost always carry one label. Mined rules are kept in an inverted index under
their rarest token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize, sized_broadcast

LABEL = "label="
ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), *ASCII)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*(/?[^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    """Whether a rule (host, then path from the first slash) fits a host or one of its subdomains and the path's beginning."""
    name, slash, rest = rule.partition("/")
    start = slash + rest
    at_host = (host == name) | host.endswith("." + name)
    return at_host & path.startswith(start) if start else at_host


def given_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, the first by code point among equals; else null.

    The rules become one expression: they are meant to be written by hand.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        found = F.when(fits(rule, host, path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: top level, domain, names and words of subdomains, first path segment, extension, query keys.

    Runs of digits read ``#``, so that a page number is no token of its own.
    """
    host, path = host_of(url), path_of(url)
    names = F.filter(F.split(host, r"\."), lambda x: x != "")
    last = F.element_at(F.array_append(F.reverse(names), F.lit(None).cast("string")), 1)
    domain = F.when(F.size(names) > 1, F.array_join(F.slice(names, -2, 2), "."))
    subs = F.when(F.size(names) > 2, F.slice(names, F.lit(1), F.size(names) - 2)).otherwise(F.array().cast("array<string>"))
    words = F.flatten(F.transform(F.filter(subs, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    query = F.split(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^?#]*\?([^#]*)", 1), "&")
    keys = F.filter(F.transform(query, lambda x: F.split(x, "=")[0]), lambda x: x != "")
    named = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind), x))
    one = lambda kind, value: F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(kind), value)))
    parts = [
        one("top:", last), one("domain:", domain), named("sub:", subs), named("word:", words), one("first:", F.regexp_extract(path, "^/([^/]*)", 1)),
        one("ext:", F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), named("key:", keys),
    ]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*parts), lambda x: F.regexp_replace(x, "[0-9]+", "#"))))


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = 0.005, min_confidence: float = 0.7, most_tokens: int = 4) -> DataFrame:
    """Rules (tokens, label, confidence, support, rarest) from URLs and labels.

    A rule has up to ``most_tokens`` tokens, holds for ``min_support`` of the URLs and gives
    its label in ``min_confidence`` of all that have its tokens, URLs without a label (null) among
    them. A rule is left out if one with some of its tokens is as confident. Rare tokens are
    dropped before mining. The number of rules does not follow the table: a URL of t frequent tokens is in
    2 ** t sets, so there are at most 2 ** t / min_support. An empty table gives no rules.
    """
    tokens, label = url_tokens(F.col(url_col)), F.col(label_col)
    baskets = labelled.select(F.when(label.isNull(), tokens).otherwise(F.array_append(tokens, F.concat(F.lit(LABEL), label))).alias("items")).filter(F.size("items") > 0)
    baskets = materialize(baskets, "baskets")
    counted = baskets.groupBy("items").count()  # equal baskets weigh as many
    total = baskets.count()
    schema = "tokens array<string>, label string, confidence double, support double, rarest string"
    if not total:
        return labelled.sparkSession.createDataFrame([], schema)
    least = max(1, -int(-total * min_support // 1))
    common = [r["item"] for r in counted.select(F.explode("items").alias("item"), "count").groupBy("item").agg(F.sum("count").alias("n")).filter(F.col("n") >= least).select("item").collect()]
    kept = baskets.select(F.filter("items", lambda x: x.isin(common) | x.startswith(LABEL)).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(kept).freqItemsets
    sets = materialize(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    is_label = lambda x: x.startswith(LABEL)
    whole = sets.filter(F.exists("items", is_label)).select(
        F.filter("items", lambda x: ~is_label(x)).alias("tokens"), F.filter("items", is_label)[0].alias("label"), F.col("freq").alias("both")
    ).filter((F.size("tokens") > 0) & (F.size("tokens") <= most_tokens))
    alone = sets.withColumnRenamed("items", "tokens")
    rules = whole.join(alone, "tokens").withColumn("confidence", F.col("both") / F.col("freq")).filter(F.col("confidence") >= min_confidence)
    single = {r["items"][0]: r["freq"] for r in sets.filter(F.size("items") == 1).collect()}
    best: dict[tuple[frozenset, str], float] = {}
    out = []
    for r in rules.orderBy(F.size("tokens"), "tokens", "label").collect():
        own, label = frozenset(r["tokens"]), r["label"].removeprefix(LABEL)
        if not any(c >= r["confidence"] for (have, of), c in best.items() if of == label and have < own):
            best[own, label] = r["confidence"]
            out.append((sorted(own), label, float(r["confidence"]), r["both"] / total, min(own, key=lambda t: (single[t], t))))
    return labelled.sparkSession.createDataFrame(out, schema)


def match(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(tokens, mined): each distinct token set of the URLs with the rule that judges it, if one does.

    Sets meet rules on a rule's rarest token; the most confident rule wins, then the one of more support, then by its tokens.
    """
    sets = materialize(urls.select(url_tokens(F.col(url_col)).alias("tokens")).distinct(), "token-sets")
    index = sized_broadcast(rules.withColumnRenamed("tokens", "needs"))
    met = sets.withColumn("rarest", F.explode("tokens")).join(index, "rarest").filter(F.size(F.array_except("needs", "tokens")) == 0)
    order = F.struct("confidence", "support", -F.size("needs"), F.array_join("needs", " "))
    won = met.groupBy("tokens").agg(F.max_by(F.struct(F.array_join("needs", " + ").alias("rule"), F.col("label").alias("verdict"), "confidence", "support"), order).alias("mined"))
    return won


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", otherwise: str = "allow", **mining) -> DataFrame:
    """The rows with host, path, rule, verdict, mined_rule and confidence.

    Given rules judge first and label the URLs for mining, where URLs that no rule fits have no
    label and speak against a rule; these get the mined verdict, or ``otherwise`` if no mined rule fits. Null URLs and those without ``://`` have an
    empty host and path, no tokens, and the verdict ``otherwise``. Columns of the same names
    are replaced; others stay as they are.
    """
    added = ["host", "path", "rule", "verdict", "mined_rule", "confidence"]
    told = urls.select(F.struct("*").alias("_row"), F.col(url_col).alias("_url"))
    told = told.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    told = told.withColumn("_given", given_rule(rules, F.col("_host"), F.col("_path")))
    labels = told.select(F.col("_url").alias("url"), F.col("_given.verdict").alias("label"))
    won = materialize(match(told.filter("_given is null"), mine(labels, **mining), "_url"), "mined")
    judged = told.withColumn("tokens", url_tokens(F.col("_url"))).join(sized_broadcast(won), "tokens", "left")
    free = F.col("_given").isNull()
    return judged.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in urls.columns if c not in added],
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_given.rule").alias("rule"),
        F.coalesce("_given.verdict", "mined.verdict", F.lit(otherwise)).alias("verdict"), F.when(free, F.col("mined.rule")).alias("mined_rule"), F.when(free, F.col("mined.confidence")).alias("confidence"),
    )
