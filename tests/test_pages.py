from pyspark.sql import functions as F

from marketloom.operators import pages as P

from .conftest import rows

LAYOUT_A = """<html><body><h1 class="buysell-title">2020 Commencal Meta TR - PRICE DROP!</h1>
<div class="buysell-container details"><b>Category:</b> Trail Bikes<br><b>Front Travel:</b> 150 mm<br>
<b>Still For Sale:</b> <span style="color:white">Sold</span><br></div>
<div class="buysell-container details"><b>Original Post Date:</b> Aug-29-2021 1:06:56<br><b>Seat Tube:</b> 44&quot;</div>
<div class="buysell-container buysell-price">$2,950 USD</div>
<div class="buysell-container description">Ridden lightly &amp; clean.<br>COMPONENTS: <b>all</b><script>var x = "<p>";</script></div>
<span class="f11">
Member since 2010
  Evergreen, United States
</span><div class="buysell-container"><b>Restrictions:</b> No Trades, Local pickup only</div></body></html>"""

LAYOUT_B = """<div class="px-3 py-4 bike-info-header"><div>Ventum GS1
 Custom</div></div><p class="text-2xl font-500 mb-0 content-primary">C$ 4.500,00</p>
<p class="text-sm content-tertiary wrap-1 mb-0"> Clermont, United States </p>
<div class="modal-header"><p class="x content-secondary">Ventum</p><h2 class="content-primary">GS1</h2></div>
<div class="general-information"><div class="d-flex align-items-center flex-nowrap"><span class="content-tertiary">Year:</span><span class="content-primary">2022</span></div>
<div class="d-flex align-items-center flex-nowrap"><span class="content-tertiary">Size:</span><span class="content-primary">-</span></div></div>
<div class="seller-info"><p class="info-text">ignored tag</p><div class="info-text">Rare</div></div>
<div class="parts parts-modal"><h3>Original Parts</h3></div>
<div class="parts parts-modal"><h3>Replaced</h3><div class="d-flex align-items-center"><span class="content-tertiary">Fork:</span><span class="content-primary">Carbon</span></div></div>"""


def test_layout_a(frame):
    row = P.parse_layout_a(frame([("u", LAYOUT_A)], "url string, html string")).first()
    assert (row.ad_title, row.category, row.front_travel) == ("2020 Commencal Meta TR - PRICE DROP!", "Trail Bikes", "150 mm")
    assert (row.still_for_sale, row.original_post_date) == ("Sold", "Aug-29-2021 1:06:56")
    assert (row.price, row.currency, row.location) == (2950.0, "USD", "Evergreen, United States")
    assert row.description == "Ridden lightly & clean.COMPONENTS: all"
    assert row.restrictions == "No Trades, Local pickup only"
    assert row.extra == {"seat_tube": '44"'}


def test_layout_b(frame):
    row = P.parse_layout_b(frame([("u", LAYOUT_B)], "url string, html string")).first()
    assert (row.ad_title, row.price, row.currency, row.location) == ("Ventum GS1 Custom", "450000", "C$", "Clermont, United States")
    assert row.description == "\n\n".join(
        ["Brand: Ventum", "Model: GS1", "General Information:", "Year: 2022", "Seller Description:", "Rare", "\nOriginal Parts:", "\nReplaced:", "Fork: Carbon"]
    )


def test_dispatch_rejects_unknown_sources_and_empty_pages(frame):
    pages = frame([("https://www.pinkbike.com/1", LAYOUT_A), ("https://buycycle.com/2", LAYOUT_B), ("https://x.example/3", LAYOUT_A), ("https://www.pinkbike.com/4", "<p>gone</p>"), ("https://www.pinkbike.com/5", None)], "url string, html string")
    parsed, rejected = P.parse_listings(pages, F.lit("2024-01-01 00:00:00").cast("timestamp"), 3)
    assert rows(parsed, "url", "price", "region_code") == [("https://buycycle.com/2", 450000.0, 3), ("https://www.pinkbike.com/1", 2950.0, 3)]
    assert rows(rejected) == [("https://x.example/3", "other")]
    normal = P.normalize_parsed(parsed, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert rows(normal, "model_year", "country") == [("2020", "United States"), ("2022", "United States")]


def test_result_pages_with_surplus_on_either_side(frame):
    link = '<a href="https://www.pinkbike.com/buysell/{}/">x</a>'
    two_links = link.format(1234567) + link.format(1234567) + link.format(2234567) + '<a name="x">no</a>'
    pages = frame(
        [(1, two_links + '<div class="bsitem boosted">'), (2, two_links + '<div class="bsitem"></div>' * 2 + '<div class="bsitem boosted">'), (3, "<p>none</p>")],
        "page_id int, html string",
    )
    assert rows(P.listing_results(pages), "page_id", "pos", "status") == [(1, 0, "boosted"), (2, 0, "not boosted"), (2, 1, "not boosted")]


def test_links_pages_and_images(frame):
    html = '<a class="q" href="/l?category=12&page=3">Trail <b>Bikes</b></a><a href="/l?page=11">11</a><div id="buysell-image" class="selectable" data-fullimageurl="/i.jpg">'
    pages = frame([(1, html), (2, "")], "page_id int, html string")
    assert rows(P.links(pages), "pos", "href", "text") == [(0, "/l?category=12&page=3", "Trail Bikes"), (1, "/l?page=11", "11")]
    assert rows(P.category_numbers(P.links(pages))) == [("Trail Bikes", 12)]
    assert rows(P.last_page(pages)) == [(1, 11), (2, 0)]
    assert rows(pages.select("page_id", P.first_image().alias("i"))) == [(1, "/i.jpg"), (2, None)]


def test_blocked_pages(frame):
    pages = frame([(1, "Sorry, You Have Been Blocked"), (2, "fine"), (3, "challenge-platform only"), (4, "/cdn-cgi/challenge-platform/h/b/orchestrate/")], "page_id int, html string")
    good, bad = P.split_blocked(pages)
    assert rows(good, "page_id") == [(2,), (3,)] and rows(bad, "page_id") == [(1,), (4,)]


def test_spec_tables(frame):
    html = "<table><tr><th>Price Range</th><td>$1</td></tr><tr><td>alone</td></tr></table><table><tr><td>Wheel-set</td><td> X </td></tr></table>"
    got = P.spec_table_rows(frame([("s", html), ("t", "<b>")], "spec_url string, html string"))
    assert rows(got) == [("s", 0, "price_range", "$1"), ("s", 1, "wheel_set", "X")]


def test_pages_of_one_task_are_parsed_by_many(frame):
    html = "<table><tr><th>Fork</th><td>Carbon</td></tr></table>"
    pages = frame([(i, html) for i in range(200)], "page_id int, html string").coalesce(1)
    per_task = P.spec_table_rows(pages, ["page_id"]).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 200 and max(r["count"] for r in per_task) <= 100


def test_model_links(frame):
    link_rows = frame([(1, 0, "/a", "2020 Santa Cruz Nomad"), (1, 1, "/b", "2020 Santana"), (1, 2, "/c", "Nomad 2020"), (2, 0, "/d", "see 2019 Trek X")], "page_id int, pos int, href string, text string")
    makers = frame([("Santa Cruz",), ("Trek",), ("Santa",)], "manufacturer string")
    got = {tuple(r) for r in P.model_links(link_rows, makers, "https://s").select("manufacturer", "model_url", "year").collect()}
    assert got == {("Santa Cruz", "https://s/a", "2020"), ("Santa", "https://s/a", "2020"), ("Santa", "https://s/b", "2020"), ("Trek", "https://s/d", "2019")}


def test_deeply_nested_page(frame):
    html = "<div>" * 5000 + '<h1 class="buysell-title">deep</h1>'
    assert P.parse_layout_a(frame([("u", html)], "url string, html string")).first().ad_title == "deep"


def test_links_of_any_quoting(frame):
    html = """<link href="/no"><!-- <a href="/no">no</a> --><a href='/list/?category=12'>C &amp; D</a><A HREF=/list/?page=7>7</A><a class="x" href="/p?a=1&amp;page=9">9"""
    pages = frame([(1, html), (2, None)], "page_id int, html string")
    assert rows(P.links(pages), "pos", "href", "text") == [(0, "/list/?category=12", "C & D"), (1, "/list/?page=7", "7"), (2, "/p?a=1&page=9", "9")]
    assert rows(P.category_numbers(P.links(pages))) == [("C & D", 12)] and rows(P.last_page(pages)) == [(1, 9), (2, 0)]


def test_failing_pages_say_why(frame):
    def parser(page):
        raise ValueError("odd page")

    out = P.parse_pages(frame([(1, "<p>x</p>")], "page_id int, html string"), parser, "title string", ["page_id"])
    assert rows(out) == [(1, None, "ValueError: odd page")]
