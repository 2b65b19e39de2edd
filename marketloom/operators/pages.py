"""Extraction from stored pages.

Attributes and block markers are regular expressions inside the JVM. Links, the two
listing layouts and spec tables need a parser; it runs over Arrow batches and
returns raw pieces of text, which column expressions then clean and type.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..session import spread

# Address patterns of the listing site.
CATEGORY_HREF = ".*category=([0-9]{1,20})"
PAGE_HREF = ".*page=([0-9]{1,20})"
LISTING_HREF = "^https://www.pinkbike.com/buysell/[0-9]{6,7}"



# --- links ---------------------------------------------------------------------


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per anchor with an address: key, pos, href, text, in page order.

    The page tree finds them, whatever their quoting; entities are decoded, comments and other tags' addresses left out.
    """
    found = parse_pages(pages, _page_links, "links array<struct<href: string, text: string>>", [key], html)
    return found.select(key, F.posexplode("links").alias("pos", "_a")).select(key, "pos", "_a.href", "_a.text")


def category_numbers(link_rows: DataFrame, order: list[str] = ("page_id", "pos")) -> DataFrame:
    """Category text -> number; a repeated text keeps the last number."""
    found = link_rows.withColumn("category_num", C.extract("href", CATEGORY_HREF).cast("bigint")).where("category_num is not null")
    return found.groupBy(F.col("text").alias("category")).agg(F.max_by("category_num", F.struct(*order)).alias("category_num"))


def listing_results(pages: DataFrame, key: str = "page_id", html: str = "html", href_pattern: str = LISTING_HREF) -> DataFrame:
    """Listing links of a result page with their status, in order.

    The i-th distinct link belongs to the i-th result block; links or blocks
    without a partner are dropped.
    """
    found = parse_pages(pages, _result_page, "hrefs array<string>, blocks array<string>", [key], html)
    hrefs = F.filter("hrefs", lambda h: h.rlike(href_pattern))
    paired = F.arrays_zip(F.array_distinct(hrefs).alias("url"), F.col("blocks").alias("block"))
    rows = found.select(key, F.posexplode(paired).alias("pos", "_p")).where("_p.url is not null and _p.block is not null")
    status = F.when(F.array_contains(F.split("_p.block", r"\s+"), "boosted"), "boosted").otherwise("not boosted")
    return rows.select(key, "pos", F.col("_p.url").alias("url"), status.alias("status"))


def last_page(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Largest page number linked from each page, 0 if none."""
    found = parse_pages(pages, _page_links, "links array<struct<href: string, text: string>>", [key], html)
    numbers = F.transform("links.href", lambda h: C.extract(h, PAGE_HREF).cast("bigint"))
    return found.select(key, F.coalesce(F.array_max(numbers), F.lit(0)).alias("last_page"))


def first_image(html: str = "html") -> Column:
    """Full-size image address of the listing's image block."""
    block = F.regexp_extract(html, r"""(?is)<div\s[^>]*\bid\s*=\s*["']?buysell-image\b[^>]*>""", 0)
    return C.extract(block, r"""(?is)data-fullimageurl\s*=\s*["']?([^"'\s>]*)""")


def is_blocked(html: str = "html") -> Column:
    return F.lower(html).contains(fv.BLOCKED_PAGE_TEXT)


def is_challenge(html: str = "html") -> Column:
    return F.col(html).contains("challenge-platform") & F.col(html).contains("/cdn-cgi/challenge-platform/h/b/orchestrate/")


def split_blocked(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    bad = F.coalesce(is_blocked(html) | is_challenge(html), F.lit(False))
    return pages.where(~bad), pages.where(bad)


def model_links(link_rows: DataFrame, makers: DataFrame, base_url: str, maker: str = "manufacturer") -> DataFrame:
    """Links whose text holds "<year> <maker>...", with the base address in front.

    The text after the year is matched to makers by equality of prefixes, one
    per maker name length, so it is an equi join.
    """
    lengths = makers.agg(F.array_sort(F.collect_set(F.length(maker)))).scalar()
    after = r"(?s)((?:19|20)[0-9]{2}) (.*)"
    rest = F.regexp_extract("text", after, 2)
    rows = link_rows.where(F.col("text").rlike(after)).withColumn("year", F.regexp_extract("text", after, 1))
    rows = rows.withColumn("_n", F.explode(lengths)).where(F.length(rest) >= F.col("_n"))
    prefix = F.substring(rest, F.lit(1), F.col("_n"))
    joined = rows.withColumn(maker, prefix).join(makers.select(maker).distinct(), maker)
    return joined.withColumn("model_url", F.concat(F.lit(base_url), "href")).drop("_n")


def families_without_models(families: DataFrame, found: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Family pages with no model link, as error rows."""
    empty = families.where(F.col(url).contains("family")).join(found.select(key), key, "left_anti")
    return empty.select(key, url, F.lit("no models found for family").alias("error"))


# --- parser forms ------------------------------------------------------------


_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(
    r"""<!--.*?-->|<![^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""",
    re.S | re.I,
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "markup", "children", "parent", "by_tag", "_attrs", "_classes")

    def __init__(self, tag: str, markup: str, parent: "Node | None"):
        self.tag, self.markup, self.parent = tag, markup, parent
        self.children: list = []
        self.by_tag: dict[str, list[Node]] | None = None  # the whole page by tag, on the root only
        self._attrs: dict | None = None
        self._classes: frozenset | None = None

    @property
    def attrs(self) -> dict:
        """Attributes, read from the tag's text on first use."""
        if self._attrs is None:
            pairs = _ATTRIBUTE.findall(self.markup) if self.markup else []
            self._attrs = {name.lower(): unescape(value.strip("\"'")) for name, value in reversed(pairs)}
        return self._attrs

    @property
    def classes(self) -> frozenset:
        if self._classes is None:
            self._classes = frozenset(self.attrs.get("class", "").split())
        return self._classes

    def walk(self):
        """Descendants in document order, without recursion: unclosed tags can nest deeply."""
        stack = self.children[::-1]
        while stack:
            item = stack.pop()
            yield item
            if isinstance(item, Node):
                stack.extend(item.children[::-1])

    @property
    def text(self) -> str:
        return "".join(c for c in self.walk() if isinstance(c, str))

    def all(self, tag: str, *classes: str):
        """Descendants of a tag that carry all the classes, in document order."""
        items = self.walk() if self.by_tag is None else self.by_tag.get(tag, ())
        for item in items:
            if isinstance(item, Node) and item.tag == tag and item.classes.issuperset(classes):
                yield item

    def first(self, tag: str, *classes: str) -> "Node | None":
        return next(self.all(tag, *classes), None)


def page_tree(html: str) -> Node:
    """Page text to a tree; comments, scripts and styles are left out, unclosed tags end with an outer one."""
    root = node = Node("", "", None)
    root.by_tag = by_tag = {}
    end = 0
    for token in _TOKEN.finditer(html):
        if token.start() > end:
            node.children.append(unescape(html[end : token.start()]))
        end = token.end()
        _, closing, tag, markup = token.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if not closing:
            child = Node(tag, markup, node)
            node.children.append(child)
            by_tag.setdefault(tag, []).append(child)
            if tag not in _VOID and not markup.endswith("/"):
                node = child
            continue
        opened = node
        while opened is not root and opened.tag != tag:
            opened = opened.parent
        if opened is not root:
            node = opened.parent
    if end < len(html):
        node.children.append(unescape(html[end:]))
    return root


def _layout_a(page: Node) -> dict:
    labels = {}
    for block in page.all("div", "buysell-container", "details"):
        for bold in block.all("b"):
            after = bold.parent.children[bold.parent.children.index(bold) + 1 :]
            if "Still For Sale" in bold.text:
                tagged = [n for n in after if isinstance(n, Node)]
                labels[bold.text] = tagged[0].text if tagged else None
            else:
                labels[bold.text] = after[0] if after and isinstance(after[0], str) else ""
    boxes = list(page.all("div", "buysell-container"))
    last = lambda nodes: ([None] + [n.text for n in nodes])[-1]
    members = [s.text for s in page.all("span", "f11") if "Member" in s.text]
    return {
        "labels": list(labels.items()),
        "price_text": last(page.all("div", "buysell-container", "buysell-price")),
        "description": last(page.all("div", "buysell-container", "description")),
        "ad_title": last(page.all("h1", "buysell-title")),
        "location": (members[-1].split("\n") + ["", "", ""])[2] if members else None,
        "restrictions": last([b for b in boxes if "Restrictions" in b.text]),
    }


# Where the second layout keeps its pieces. A step is a tag and its classes; "=" asks for this very class text.
SECOND_LAYOUT = {
    "ad_title": ("div =px-3 py-4 bike-info-header", "div"),
    "price_text": ("p =text-2xl font-500 mb-0 content-primary",),
    "location": ("p =text-sm content-tertiary wrap-1 mb-0",),
    "brand": ("div modal-header", "p content-secondary"),
    "model": ("div modal-header", "h2 content-primary"),
    "seller": ("div seller-info", "div info-text"),
}
SECOND_LAYOUT_FACTS = {
    "general": ("div general-information", "div d-flex align-items-center flex-nowrap"),
    "parts": ("div parts parts-modal", "div d-flex align-items-center"),
}
FACT = ("span content-tertiary", "span content-primary")
FACTS = "array<struct<title: string, facts: array<struct<label: string, value: string>>>>"
PIECES = ", ".join([*(f"{k} string" for k in SECOND_LAYOUT), *(f"{k} {FACTS}" for k in SECOND_LAYOUT_FACTS)])


def _select(node: Node, steps: tuple[str, ...]):
    """Nodes that a chain of steps leads to, in document order."""
    tag, _, classes = steps[0].partition(" ")
    named = () if classes.startswith("=") else classes.split()
    for found in node.all(tag, *named):
        if named or not classes or found.attrs.get("class") == classes[1:]:
            yield from _select(found, steps[1:]) if len(steps) > 1 else (found,)


def _stripped(node: Node, *steps: str) -> str | None:
    return next((n.text.strip() for n in _select(node, steps)), None)


def _second_layout(page: Node) -> dict:
    """Single pieces by name; blocks of facts as titles with rows of label and value."""
    pieces = {name: _stripped(page, *steps) for name, steps in SECOND_LAYOUT.items()}
    for name, (block, row) in SECOND_LAYOUT_FACTS.items():
        pieces[name] = [
            {"title": _stripped(b, "h3"), "facts": [{"label": _stripped(r, FACT[0]), "value": _stripped(r, FACT[1])} for r in _select(b, (row,))]}
            for b in _select(page, (block,))
        ]
    return pieces


def _page_links(page: Node) -> dict:
    return {"links": [{"href": a.attrs["href"], "text": a.text} for a in page.all("a") if "href" in a.attrs]}


def _result_page(page: Node) -> dict:
    blocks = [d.attrs["class"] for d in page.all("div", "bsitem")]
    return {"hrefs": [a.attrs["href"] for a in page.all("a") if "href" in a.attrs], "blocks": blocks}


def _spec_rows(page: Node) -> list[dict]:
    rows = []
    for number, table in enumerate(page.all("table")):
        for row in table.all("tr"):
            cells = [c.text.strip() for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
            if len(cells) >= 2:
                rows.append({"table_no": number, "label": cells[0], "value": cells[1]})
    return rows


PARSED = (
    "labels map<string,string>, price_text string, description string, ad_title string, location string, restrictions string"
)


def parse_pages(pages: DataFrame, parser, schema: str, keep: list[str], html: str = "html") -> DataFrame:
    """Run a page parser over batches; a page that fails gives one row with null pieces and the reason in ``parse_error``.

    Pages are dealt out over the session's full width first: parsing takes far longer than moving them, and a small file is one task.
    """
    fields = T.StructType([pages.schema[c] for c in keep] + T.StructType.fromDDL(f"{schema}, parse_error string").fields)
    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            rows = []
            for record in batch.to_pylist():
                base = {c: record[c] for c in keep}
                try:
                    found = parser(page_tree(record[html] or ""))
                except Exception as error:
                    found = {"parse_error": f"{type(error).__name__}: {error}"}
                rows += [{**base, **piece} for piece in (found if isinstance(found, list) else [found])]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spread(pages.select(*keep, html)).mapInArrow(run, fields)


LISTING_LABELS = [
    "category", "condition", "frame_size", "wheel_size", "material", "front_travel", "rear_travel",
    "original_post_date", "last_repost_date", "still_for_sale", "view_count", "watch_count",
]


def parse_layout_a(pages: DataFrame, keep: list[str] = ("url",), html: str = "html") -> DataFrame:
    """Listings of the first layout: known labels as columns, the rest in `extra`."""
    raw = parse_pages(pages, _layout_a, PARSED, list(keep), html)
    name = lambda k, v: F.lower(F.regexp_replace(F.regexp_replace(k, ":", ""), " ", "_"))
    labels = F.transform_values(F.transform_keys("labels", name), lambda k, v: C.collapse_whitespace(v))
    rows = raw.withColumn("_labels", labels)
    rest = F.map_filter("_labels", lambda k, v: ~k.isin(LISTING_LABELS))
    return rows.select(
        *keep,
        *[F.try_element_at("_labels", F.lit(c)).alias(c) for c in LISTING_LABELS],
        *[v.alias(k) for k, v in C.price_and_currency("price_text").items()],
        *[C.collapse_whitespace(c).alias(c) for c in ("description", "ad_title", "location")],
        C.collapse_whitespace(F.element_at(F.split("restrictions", ":"), -1)).alias("restrictions"),
        rest.alias("extra"),
    )


def parse_layout_b(pages: DataFrame, keep: list[str] = ("url",), html: str = "html") -> DataFrame:
    """Listings of the second layout; the price stays text and the posting time is the scrape time."""
    raw = parse_pages(pages, _second_layout, PIECES, list(keep), html)
    return raw.select(
        *keep,
        C.collapse_whitespace("ad_title").alias("ad_title"),
        *[v.alias(k) for k, v in C.symbol_price("price_text").items()],
        "location",
        second_layout_description().alias("description"),
    )


def second_layout_description() -> Column:
    """Description of the second layout's pieces: sections under their headings, facts as "label: value", blank lines between."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    none = F.array().cast("array<string>")

    def lines(facts: Column) -> Column:
        told = F.filter(facts, lambda f: f["label"].isNotNull() & f["value"].isNotNull() & (f["value"] != "-"))
        return F.transform(told, lambda f: F.concat(F.regexp_replace(f["label"], ":+$", ""), F.lit(": "), f["value"]))

    maker = F.when(F.col("brand").isNotNull() & F.col("model").isNotNull(), F.array(F.concat(F.lit("Brand: "), "brand"), F.concat(F.lit("Model: "), "model")))
    general = F.when(F.size("general") > 0, F.concat(F.array(F.lit("General Information:")), lines(F.col("general")[0]["facts"])))
    seller = F.when(given(F.col("seller")), F.array(F.lit("Seller Description:"), F.col("seller")))
    titled = F.filter("parts", lambda p: p["title"].isNotNull())
    parts = F.flatten(F.transform(titled, lambda p: F.concat(F.array(F.concat(F.lit("\n"), p["title"], F.lit(":"))), lines(p["facts"]))))
    return F.array_join(F.concat(*[F.coalesce(section, none) for section in (maker, general, seller, parts)]), "\n\n")


def parse_listings(
    pages: DataFrame, scraped_at: Column, region_code: int = 3, html: str = "html", url: str = "url"
) -> tuple[DataFrame, DataFrame]:
    """Dispatch by source: parsed listings with stamps, and rejected pages of unknown source."""
    tagged = pages.withColumn("mode", C.listing_source(url))
    a = parse_layout_a(tagged.where("mode = 'pinkbike'"), [url], html)
    a = a.where(F.coalesce("ad_title", "description", "category", "location", F.col("price").cast("string")).isNotNull())
    b = parse_layout_b(tagged.where("mode = 'buycycle'"), [url], html)
    b = b.where(F.col("ad_title").isNotNull() | F.col("price").isNotNull() | (F.col("description") != ""))
    b = b.withColumn("price", F.col("price").try_cast("double")).withColumn("original_post_date", scraped_at.cast("string"))
    parsed = a.unionByName(b, allowMissingColumns=True)
    stamped = parsed.withColumn("region_code", F.lit(region_code)).withColumn("datetime_scraped", scraped_at)
    return stamped, tagged.where("mode = 'other'").select(url, "mode")


def normalize_parsed(df: DataFrame, scraped_at: Column) -> DataFrame:
    """Model year from title and description where missing, country from location, scrape time."""
    year = C.model_year("ad_title", "description", ": ")
    if "model_year" in df.columns:
        year = F.coalesce("model_year", year)
    return df.withColumns({"model_year": year, "country": C.known_country("location"), "datetime_scraped": scraped_at})


def spec_table_rows(pages: DataFrame, keep: list[str] = ("spec_url",), html: str = "html") -> DataFrame:
    """Label/value rows of every table: keep, table_no, label, value."""
    rows = parse_pages(pages, _spec_rows, "table_no int, label string, value string", list(keep), html)
    return rows.where("label is not null").withColumn("label", F.lower(F.regexp_replace("label", r"[\s-]", "_"))).drop("parse_error")
