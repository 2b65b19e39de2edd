import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions import columns as C
from marketloom.functions import fixed_values as fv
from marketloom.functions.similarity import ascii_fold

from .conftest import rows


def values(frame, texts, *cols, kind="string"):
    df = frame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_convert_to_float_keeps_digits_and_dots(frame):
    df = frame([(1, "-5"), (2, "1e+20"), (3, "1,200"), (4, "$3.50"), (5, "make offer"), (6, None), (7, "1.2.3"), (8, "")], "i int, p string")
    got = dict(rows(C.convert_to_float(df, ["p"])))
    assert got == {1: 5.0, 2: 120.0, 3: 1200.0, 4: 3.5, 6: 0.0, 7: None}


def test_convert_to_float_of_numbers(frame):
    df = frame([(1, -5.0), (2, None), (3, float("nan"))], "i int, p double")
    assert rows(C.convert_to_float(df, ["p"])) == [(1, 5.0), (2, 0.0), (3, 0.0)]


def test_price_and_currency(frame):
    got = values(frame, ["$1,200 CAD", "make offer", None], *C.price_and_currency("t").values())
    assert got == [(1200.0, "CAD"), (None, None), (None, None)]


def test_symbol_price_strips_both_separators(frame):
    got = values(frame, ["1.234,50 €", "£900", "C$ 20", "free"], *C.symbol_price("t").values())
    assert got == [("123450", "EUR"), ("900", "GBP"), ("20", "C$"), (None, None)]


def test_first_number(frame):
    got = values(frame, ["150 mm", "0", ".5", "none", None, "120.5/110"], C.first_number("t"))
    assert [v for (v,) in got] == [150.0, None, 0.5, None, None, 120.5]


def test_list_price(frame):
    got = values(frame, ["$2,499", "about $2,499", "costs about $3,100.50 new", "unknown", None], C.list_price("t"))
    assert [v for (v,) in got] == [2499.0, 2499.0, 3100.5, None, None]


def test_model_year_first_match_without_word_boundary(frame):
    df = frame([("$1999 for a 2005", "x"), ("2000mm bar", "y"), ("bike", "from 2018"), ("bike", None), ("1850", "no")], "a string, b string")
    assert [r[0] for r in df.select(C.model_year("a", "b")).collect()] == ["1999", "2000", "2018", None, None]


def test_age_at_post(frame):
    d = dt.date(2020, 3, 1)
    df = frame([("2018 bike", "x", d), ("bike", "x", d), ("2021 bike", "x", d), ("2018", None, d)], "a string, b string, d date")
    assert [r[0] for r in df.select(C.age_at_post("a", "b", "d")).collect()] == [790, -1000, -306, -1000]


def test_covid_flag_is_strict(frame):
    stamps = ["2020-03-20 00:00:00", "2020-03-20 00:00:01", "2022-07-31 23:59:59", "2022-08-01 00:00:00"]
    got = values(frame, stamps, C.covid_flag(F.col("t").cast("timestamp_ntz")))
    assert [v for (v,) in got] == [0, 1, 1, 0]


def test_dates_of_several_formats(frame):
    got = values(frame, ["Aug-29-2021 1:06:56", "2021-08-29", "2021-08-29 01:06:56", "soon"], C.parse_post_date("t").cast("string"))
    assert [v for (v,) in got] == ["2021-08-29 01:06:56", "2021-08-29 00:00:00", "2021-08-29 01:06:56", None]


def test_month_start_of_last_second(frame):
    got = values(frame, ["2021-01-31 23:59:59", "2021-02-01 00:00:00"], C.month_start(F.col("t").cast("timestamp")).cast("string"))
    assert [v for (v,) in got] == ["2021-01-01", "2021-02-01"]


def test_country_functions(frame):
    texts = ["Evergreen, United States", "Nowhere", "A, B, Canada"]
    got = values(frame, texts, C.country_last_part("t"), C.country_pattern("t"), C.known_country("t"))
    assert got == [("United States", "United States", "United States"), ("Nowhere", None, None), ("Canada", "B", "Canada")]


def test_plain_name_agrees_with_the_full_fold(frame):
    got = values(frame, ["Škoda-Bike Co", "Ünö é", "Łódź"], C.plain_name("t"), ascii_fold("t"))
    assert all(a == b for a, b in got)
    assert got[0][0] == "skodabikeco"


def test_catalogue_key_is_null_when_a_part_is(frame):
    parts = C.spec_url_parts("t")
    got = values(frame, ["https://x/en/bikes/trek/2018/Slash-9-8", "https://x/none"], *parts.values(), C.catalogue_key(parts["year"], parts["manufacturer"], parts["model"]))
    assert got == [("trek", "2018", "Slash-9-8", "2018 trek slash 9 8"), (None, None, None, None)]


def test_currency_codes(frame):
    got = values(frame, [*fv.CURRENCY_SYMBOLS, "PLN"], C.currency_code("t"))
    assert [v for (v,) in got] == [*fv.CURRENCY_SYMBOLS.values(), "PLN"]


def test_fixed_rates(frame):
    got = values(frame, ["USD", "GBP", "EUR", "CAD", "zl", None], C.fixed_rate_cad(F.lit(100.0), "t"))
    assert [v for (v,) in got] == [125.0, 174.0, 149.0, 100.0, None, None]


def test_urls(frame):
    got = values(frame, ["a.example/x/123/", "http://a.example"], C.with_scheme("t"), C.file_stem("t"))
    assert got == [("https://a.example/x/123/", "123"), ("http://a.example", "")]
    got = values(frame, ["https://g/?target=https%3A%2F%2Fm.example%2Fb%3F99spokes%3D1", "https://g/"], C.redirect_target("t"))
    assert [v for (v,) in got] == ["https://m.example/b", None]


def test_shipping_label_takes_the_first(frame):
    got = values(frame, ["globally, Local pickup only", "ship locally", "none", None], C.shipping_label("t"))
    assert [v for (v,) in got] == ["local_pickup_only", "ship_locally", "None", "None"]


def test_overpriced_text(frame):
    df = frame([(1200.0,), (800.0,), (1000.0,), (None,)], "p double")
    got = [r[0] for r in df.select(C.overpriced("p", F.lit(1000.0), F.lit("CAD"))["price_text"]).collect()]
    assert got == ["Overpriced by CAD $200.00 (20.00%)", "Underpriced by CAD $200.00 (20.00%)", "Priced perfectly", None]


def test_whitespace_and_names(frame):
    got = values(frame, ["  a \n\tb  c "], C.collapse_whitespace("t"))
    assert got == [("a b c",)]
    df = frame([(1, 2)], "`Original Post Date:` int, b int")
    assert C.normalize_names(df).columns == ["original_post_date", "b"]
    assert C.spec_name("Wheel-set Size") == "wheel_set_size"


@pytest.mark.parametrize("lat, lon, km", [(0.0, 180.0, 20015.0868), (51.05, -114.07, 0.0), (90.0, 0.0, None)])
def test_haversine(frame, lat, lon, km):
    start = (0.0, 0.0) if km and km > 1000 else (51.05, -114.07)
    got = frame([(lat, lon)], "a double, b double").select(C.haversine_km(F.lit(start[0]), F.lit(start[1]), "a", "b")).first()[0]
    assert got == pytest.approx(km if km is not None else 4331.1, abs=0.5)


def test_whole_days_rounds_down(frame):
    df = frame([("2021-01-02 00:00:00", "2021-01-01 12:00:00"), ("2021-01-01 00:00:00", "2021-01-02 23:00:00")], "a string, b string")
    got = [r[0] for r in df.select(C.whole_days(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))).collect()]
    assert got == [-1, 1]


def test_pairs_scored_together_equal_each_by_itself():
    import random

    from marketloom.functions import similarity

    random.seed(8)
    word = lambda n: "".join(random.choices("abcé😀", k=n))
    pairs = [(word(random.randint(0, 9)), word(random.randint(0, 30))) for _ in range(400)]
    pairs += [(word(6), word(6)) for _ in range(60)] + [(word(70), word(90)), ("abc", "abc"), ("b", "abc")]

    def windows(a, b):
        if not a or not b:
            return 100.0 if a == b else 0.0
        ways = [(a, b)] * (len(a) <= len(b)) + [(b, a)] * (len(b) <= len(a))
        return max(similarity._best_window(s, t) for s, t in ways)

    found = similarity.pair_ratios(pairs)
    assert all(found[p] == windows(*p) == similarity.partial_ratio(*p) for p in pairs)
