"""Saved conditions: what they may say, and what they may not reach."""

import random

import pytest

from marketloom.operators import filters
from marketloom.operators.rules import RuleError, parse

from .conftest import rows

COLUMNS = "ad_title string, price double, currency string, `odd name` int, posted date"


@pytest.fixture
def ads(frame):
    import datetime as dt

    day = dt.date(2024, 1, 5)
    return frame([("Norco Range", 900.0, "CAD", 1, day), ("norco it's", 2500.0, "USD", 2, None), ("Kona 50%", None, None, 3, day), ("", -5.0, "CAD", None, None), (None, 10.0, "EUR", 5, day)], COLUMNS)


GOOD = [
    ("ad_title like '%Norco%' and price < 5000", [900.0]),
    ("AD_TITLE ilike 'NORCO%'", [900.0, 2500.0]),
    ("price between 10 and 900 or currency is null", [10.0, 900.0, None]),
    ("not price > 0", [-5.0]),
    ("ad_title = 'norco it''s' or ad_title = \"Norco Range\"", [900.0, 2500.0]),
    ("ad_title = 'norco it\\'s'", [2500.0]),
    ("ad_title like '%50\\%'", [None]),
    ("currency in ('CAD', 'USD') and price not in (900)", [-5.0, 2500.0]),
    ("currency not in ['CAD', 'USD']", [10.0]),
    ("0 < price < 1000", [10.0, 900.0]),
    ("price * 2 - 100 >= 1700 & currency == 'CAD' | price == -5", [-5.0, 900.0]),
    ("~(price > 0) | price != price", [-5.0]),
    ("`odd name` % 2 = 1 and `odd name` <> 5", [900.0, None]),
    ("ad_title.str.contains('norco|kona', case=False)", [900.0, 2500.0, None]),
    ("ad_title.str.contains('50%', regex=False)", [None]),
    ("ad_title.str.startswith('Norco') and price.notnull()", [900.0]),
    ("ad_title.str.contains('x', na=True) | ad_title.str.lower() == 'norco range'", [10.0, 900.0]),
    ("ad_title.str.len() == 0", [-5.0]),
    ("coalesce(price, 0) = 0 or upper(currency) = 'EUR'", [10.0, None]),
    ("case when price > 1000 then currency = 'USD' when price is null then true else false end", [2500.0, None]),
    ("case currency when 'CAD' then price else 0 end < 0", [-5.0]),
    ("posted >= '2024-01-01' and year(posted) = 2024 and price is not null", [10.0, 900.0]),
    ("cast(price as int) = 900 or try_cast(ad_title as double) > 1", [900.0]),
    ("if(currency = 'EUR', true, price = 2.5e3)", [10.0, 2500.0]),
    ("substring(ad_title, 1, 5) || '!' = 'Norco!'", [900.0]),
]

BAD = [
    "", "   ", "price", "price <", "pricee < 3", "price < 3 price", "price < 3; drop table x", "(price < 3", "price < 3)", "price in", "not", "1.2.3 = 1",
    "reflect('java.lang.System', 'getProperty', 'user.name') = 'x'",
    "reflect/**/('java.lang.System', 'getProperty', 'java.version') like '%'",
    "reflect /* ) */ ('java.lang.System', 'getProperty', 'java.version') like '%'",
    "r'\\' = ad_title or reflect('java.lang.System', 'getProperty', 'user.name') like '%' or ad_title = r'\\'",
    "`reflect`('java.lang.System', 'getProperty', 'user.name') = 'x'",
    "java_method('java.lang.System', 'getProperty', 'user.name') = 'x'",
    "lower(reflect('java.lang.System', 'getProperty', 'user.name')) = 'x'",
    "price < 3 -- and more", "price < 3 # more", "price in (select 1)", "exists(select 1)", "price < (select max(price) from x)",
    "ad_title like currency", "ad_title.str.replace('a', 'b') = 'c'", "ad_title.__class__ = 'x'", "ad_title.str.contains(currency)",
    "ad_title.str.contains('a', flags=True)", "@price < 3", "price < $1", "x -> x", "transform(array(1), x -> x) is null", "input_file_name() = 'x'",
    "java.lang.System = 1", "cast(price as struct<a:int>) is null", "abs() = 1", "abs(price, 1) = 1", "case end", "price is 3", "price not 3",
    "'unterminated", "ad_title = 'a\\'", "(" * 500 + "price" + ")" * 500 + " < 3", "price < 3 and " * 2000 + "price < 3",
]


@pytest.mark.parametrize("text,prices", GOOD)
def test_rules_hit(ads, text, prices):
    assert [r[0] for r in rows(filters.where_rule(ads, text), "price")] == sorted(prices, key=lambda v: (v is not None, str(v)))


@pytest.mark.parametrize("text", BAD)
def test_rules_turned_away(ads, text):
    with pytest.raises(RuleError):
        filters.where_rule(ads, text)


def test_no_text_names_a_function_that_is_not_listed():
    """Random mutations of hostile texts never parse to a call beyond the list."""
    from marketloom.operators.rules import FUNCTIONS

    def calls(node):
        if isinstance(node, tuple) and node and node[0] == "call":
            yield node[1]
        if isinstance(node, (tuple, list)):
            for part in node:
                yield from calls(part)

    rng = random.Random(3)
    alphabet = ["reflect", "lower", "(", ")", "'", "\\", "`", "/*", "*/", "--", "\n", " ", "r'", '"', "ad_title", ",", "=", "or", "'x'", "."]
    read = 0
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 14)))
        try:
            tree = parse(text)
        except RuleError:
            continue
        read += 1
        assert set(calls(tree)) <= set(FUNCTIONS)
    assert read > 20
