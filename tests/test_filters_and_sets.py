import pytest
from pyspark.sql import functions as F

from marketloom.operators import filters, sets, sorting

from .conftest import rows


def test_plausible_price_bounds(frame):
    prices = [100.0, 100.01, 19999.99, 20000.0, 123.0, 1234.0, 12345.0, None, 500.0]
    df = frame([(p,) for p in prices], "price double")
    assert rows(filters.plausible_price(df)) == [(100.01,), (19999.99,), (500.0,)]


def test_phrases_drop_null_and_any_case(frame):
    df = frame([("STOLEN bike",), ("Looking For one",), (None,), ("fine",)], "description string")
    assert rows(filters.without_phrases(df)) == [("fine",)]


def test_null_currency_survives_not_equal(frame):
    df = frame([("zl",), (None,), ("CAD",)], "currency string")
    assert rows(filters.currency_not(df)) == [(None,), ("CAD",)]
    assert rows(filters.currency_in(df, ["CAD"])) == [("CAD",)]


def test_bike_categories(frame):
    df = frame([("Trail Bikes",), ("Bike Parts",), ("BIKES",), ("Frames",), ("Trail Bikes",), ("BMX Bikes",)], "category string")
    assert rows(filters.bike_categories(df)) == [("BIKES",), ("Trail Bikes",)]


@pytest.mark.parametrize("text", ["pricee > 3", "price >", "price + 1"])
def test_bad_rules_raise(frame, text):
    df = frame([(1.0,)], "price double")
    with pytest.raises(filters.RuleError):
        filters.where_rule(df, text)


def test_location_format(frame):
    df = frame([("Calgary, Canada",), ("Calgary",), (" , Canada",), ("Calgary, ",), (None,), ("a,b,c",)], "location string")
    good, bad = filters.split_valid_requests(df)
    assert rows(good) == [("Calgary, Canada",), ("a,b,c",)]
    assert bad.count() == 4


def test_trailing_days_are_strict(frame):
    df = frame([(f"2024-01-{d:02d}",) for d in range(1, 31)], "d string").select(F.col("d").cast("date").alias("d"))
    got = [str(r[0])[-2:] for r in filters.trailing_days(df, "d", F.lit("2024-01-20").cast("date")).orderBy("d").collect()]
    assert got == [f"{d:02d}" for d in range(11, 20)]


def test_drop_sparse_columns(frame):
    df = frame([(i, None if i else 1, "x") for i in range(5)], "a int, b int, c string")
    assert filters.drop_sparse_columns(df, 2).columns == ["a", "c"]


def test_alert_projection_fills_text_zero(frame):
    df = frame([("u", None, 2.5)], "url string, price_change double, price double")
    assert rows(filters.alert_projection(df, ["url", "price_change", "price"])) == [("u", "0", "2.5")]


def test_top_k_null_order(frame):
    df = frame([("a", 1.0), ("b", None), ("c", 3.0)], "url string, v double")
    assert [r.url for r in sorting.top_k(df, "v", 2, "first").collect()] == ["b", "c"]
    assert [r.url for r in sorting.top_k(df, "v", 2, "last").collect()] == ["c", "a"]


def test_sort_mixed_puts_nulls_last(frame):
    df = frame([(1.0, 2.0), (None, 1.0), (1.0, None), (2.0, 9.0)], "a double, b double")
    assert [tuple(r) for r in sorting.sort_mixed(df, ["a"], ["b"]).collect()] == [(2.0, 9.0), (1.0, 2.0), (1.0, None), (None, 1.0)]


def test_sample_does_not_depend_on_partitions(frame):
    df = frame([(i,) for i in range(500)], "k int")
    a = rows(sorting.sample_n(df.repartition(1), "k", 20))
    assert a == rows(sorting.sample_n(df.repartition(7), "k", 20))
    assert len(a) == 20 and a != rows(sorting.sample_n(df, "k", 20, seed=1))


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
@pytest.mark.parametrize("whole_below", [0, 100_000])
def test_exact_quantiles(frame, n, whole_below):
    """Both ways of bracketing, ties, a constant column, nulls and NaN."""
    import random

    import numpy as np

    random.seed(n)
    data = [round(random.choice([random.random() * 1e6, 5.0, -3.0]), 3) for _ in range(n)]
    df = frame([(v, 4, float("nan") if i % 3 else v, None) for i, v in enumerate(data)] + [(None, None, None, None)], "v double, c int, w double, e int")
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = sorting.exact_quantiles(df.repartition(3), ["v", "c", "w", "e"], shares, whole_below=whole_below)
    assert got["v"] == pytest.approx(list(np.quantile(data, shares)))
    assert got["w"] == pytest.approx(list(np.quantile(data[::3], shares)))
    assert got["c"] == [4.0] * 5 and got["e"] == [None] * 5


def test_exact_quantiles_when_sketches_are_coarse(frame):
    """With a sketch of accuracy 20 brackets are real and ranks are still exact."""
    import random

    import numpy as np

    random.seed(9)
    data = [random.lognormvariate(0, 3) for _ in range(5_000)] + [float("inf"), -float("inf"), -1e308, 1e308]
    df = frame([(v, -v) for v in data], "v double, w double").repartition(7)
    got = sorting.exact_quantiles(df, ["v", "w"], [0.25, 0.5], accuracy=20, whole_below=10)
    assert got["v"] == pytest.approx(list(np.quantile(data, [0.25, 0.5])))
    assert got["w"] == pytest.approx(list(np.quantile([-v for v in data], [0.25, 0.5])))


def test_exact_quantiles_read_twice(spark, frame):
    """Two passes, however many columns there are."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = frame([(float(i), float(-i), 2.0 * i) for i in range(500)], "a double, b double, c double").mapInPandas(seen, "a double, b double, c double")
    assert sorting.exact_quantiles(df, ["a", "b", "c"]) == {"a": [249.5], "b": [-249.5], "c": [499.0]}
    assert reads.value <= 1_000


def test_exact_median_of_nothing(frame):
    assert sorting.exact_median(frame([(None,)], "v double"), "v") is None


def test_mode_prefers_the_smaller_on_ties(frame):
    df = frame([(3,), (2,), (3,), (2,), (None,), (None,), (None,)], "v int")
    assert sorting.mode_value(df, "v").first()[0] == 2


def test_unions(frame):
    a, b = frame([(1, "x")], "k int, v string"), frame([(1,), (2,)], "k int")
    assert rows(sets.union_by_name(a, b)) == [(1, None), (1, "x"), (2, None)]
    assert rows(sets.union_first_wins([a, b], ["k"])) == [(1, "x"), (2, None)]
    assert rows(sets.key_difference(b, a, key="k")) == [(2,)]


def test_last_page_wins(frame):
    df = frame([("u", "boosted", 1, 0), ("u", "not boosted", 2, 5), ("w", "boosted", 1, 1)], "url string, status string, page_no int, pos int")
    assert rows(sets.last_page_wins(df)) == [("u", "not boosted"), ("w", "boosted")]


def test_large_samples_and_top_k_equal_the_plain_form(frame):
    df = frame([(i, (i * 7919) % 3001) for i in range(9000)], "k int, v int")
    plain = rows(df.orderBy(sorting.hashed_order("k"), "k").limit(1500))
    assert rows(sorting.sample_n(df, "k", 1500)) == plain
    assert rows(sorting.top_k_of_many(df, "v", 700, ["k"])) == rows(sorting.top_k(df, "v", 700, tiebreak=["k"]))
    assert sorting.top_k_of_many(df, "v", 10_000, ["k"]).count() == 9000


def test_search_answer_as_markdown(frame):
    from marketloom.plans.search import as_markdown

    df = frame([("a", 1.5), ("b", None)], "ad_title string, price double")
    assert as_markdown(df) == "| ad_title | price |\n|---|---|\n| a | 1.5 |\n| b |  |"
    assert as_markdown(df.where("false")) == "No bikes found matching your criteria."
