"""Scalar functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract(c: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """First regex match, null when there is none."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))


# --- text -----------------------------------------------------------------


def collapse_whitespace(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)[\s\x1c-\x1f]+", " "))


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column, whatever whitespace surrounds it."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    edge = r"(?U)^\s+|\s+$"
    return df.withColumns({c: F.regexp_replace(F.col(c), edge, "") for c in strings})


def objects_to_string(df: DataFrame) -> DataFrame:
    """Cast columns of nested type to text; nulls stay null."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, nested)})


def normal_name(name: str) -> str:
    return name.replace(":", "").replace(" ", "_").lower()


def spec_name(name: str) -> str:
    return "".join("_" if ch.isspace() or ch == "-" else ch for ch in name).lower()


def normalize_names(df: DataFrame, rule=normal_name) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def country_last_part(location: ColumnOrName) -> Column:
    return F.trim(F.element_at(F.split(_col(location), ","), -1))


def country_pattern(location: ColumnOrName) -> Column:
    return extract(location, fv.COUNTRY_PATTERN)


def known_country(location: ColumnOrName) -> Column:
    return extract(location, fv.KNOWN_COUNTRY_PATTERN)


def model_year(title: ColumnOrName, description: ColumnOrName, separator: str = " ") -> Column:
    """First four-digit year of title and description; null if either is null."""
    return extract(F.concat(_col(title), F.lit(separator), _col(description)), fv.MODEL_YEAR_PATTERN)


def remove_years(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), fv.MODEL_YEAR_PATTERN, "")


def title_description(title: ColumnOrName, description: ColumnOrName) -> Column:
    return F.concat(_col(title), F.lit(" "), _col(description))


def spec_url_parts(url: ColumnOrName) -> dict[str, Column]:
    names = {"manufacturer": 1, "year": 2, "model": 3}
    return {name: extract(url, fv.SPEC_URL_PATTERN, group) for name, group in names.items()}


def catalogue_key(year: ColumnOrName, manufacturer: ColumnOrName, model: ColumnOrName) -> Column:
    readable = F.lower(F.regexp_replace(_col(model), "-", " "))
    return F.concat(_col(year), F.lit(" "), _col(manufacturer), F.lit(" "), readable)


def plain_name(c: ColumnOrName) -> Column:
    """Lower case without accents, spaces and hyphens; other non-ASCII letters vanish.

    Covers the Latin accents below; ``similarity.ascii_fold`` does every script.
    """
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīńňōőřśşšťūůűźżž"
    plain = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeginnoorssstuuuzzz"
    return F.regexp_replace(F.translate(F.lower(_col(c)), accented, plain), r"[ \-]|[^\x00-\x7F]", "")


def unknown_to_null(c: ColumnOrName) -> Column:
    return F.nullif(_col(c), F.lit("Unknown"))


def shipping_label(c: ColumnOrName) -> Column:
    label = F.lit(None).cast("string")
    for phrase, name in reversed(fv.SHIPPING_LABELS):
        label = F.when(_col(c).contains(phrase), name).otherwise(label)
    return F.coalesce(label, F.lit("None"))


def mentions_price(c: ColumnOrName) -> Column:
    return _col(c).rlike(fv.PRICE_MENTION_PATTERN)


def listing_source(url: ColumnOrName) -> Column:
    return (
        F.when(_col(url).contains("pinkbike"), "pinkbike").when(_col(url).contains("buycycle"), "buycycle").otherwise("other")
    )


def with_scheme(url: ColumnOrName) -> Column:
    return F.when(_col(url).rlike("^https?://"), _col(url)).otherwise(F.concat(F.lit("https://"), _col(url)))


def redirect_target(url: ColumnOrName, tail: str = "?99spokes") -> Column:
    """Decoded part after ``target=``, up to the tracking tail."""
    encoded = F.try_element_at(F.split(_col(url), "target="), F.lit(2))
    return F.substring_index(F.try_url_decode(encoded), tail, 1)


def file_stem(url: ColumnOrName) -> Column:
    """Second-last path segment; null when there is none."""
    return F.try_element_at(F.split(_col(url), "/"), F.lit(-2))


def flatten(c: ColumnOrName) -> Column:
    return F.flatten(_col(c))


def markdown_row(*cols: ColumnOrName) -> Column:
    cells = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def html_row(*cols: ColumnOrName) -> Column:
    cells = [F.concat(F.lit("<td>"), F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in cols]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


# --- numbers and money ----------------------------------------------------


def digits_to_double(c: ColumnOrName) -> Column:
    """Keep digits and dots, null counts as 0; null when nothing or no number is left."""
    kept = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("0")), r"[^\d.]", "")
    return F.nullif(kept, F.lit("")).try_cast("double")


def convert_to_float(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to double; rows with no digit or dot left in one of them are dropped.

    A numeric column loses its sign, as its text form would, and null becomes 0.
    """
    for name in columns:
        if isinstance(df.schema[name].dataType, T.NumericType):
            number = F.col(name).cast("double")
            df = df.withColumn(name, F.coalesce(F.abs(F.nanvl(number, F.lit(0.0))), F.lit(0.0)))
            continue
        text = F.coalesce(F.col(name).cast("string"), F.lit("0"))
        df = df.where(text.rlike(r"[\d.]")).withColumn(name, digits_to_double(name))
    return df


def price_and_currency(text: ColumnOrName) -> dict[str, Column]:
    digits = F.regexp_replace(F.regexp_extract(_col(text), fv.PRICE_CURRENCY_PATTERN, 1), ",", "")
    return {"price": digits.try_cast("double"), "currency": extract(text, fv.PRICE_CURRENCY_PATTERN, 2)}


def symbol_price(text: ColumnOrName) -> dict[str, Column]:
    """Price (as digits, both separators dropped) and the symbol on either side."""
    digits = F.translate(F.regexp_extract(_col(text), fv.SYMBOL_PRICE_PATTERN, 2), ".,", "")
    before = F.trim(F.regexp_extract(_col(text), fv.SYMBOL_PRICE_PATTERN, 1))
    after = F.trim(F.regexp_extract(_col(text), fv.SYMBOL_PRICE_PATTERN, 3))
    symbol = F.when(before != "", before).otherwise(after)
    found = F.nullif(digits, F.lit(""))
    return {"price": found, "currency": F.when(found.isNotNull(), currency_code(symbol, fv.LAYOUT_B_SYMBOLS))}


def first_number(c: ColumnOrName) -> Column:
    """First decimal number in a text; 0 becomes null."""
    found = F.nullif(F.regexp_extract(_col(c).cast("string"), fv.FIRST_NUMBER_PATTERN, 0), F.lit(""))
    return F.nullif(found.try_cast("double"), F.lit(0.0))


def list_price(c: ColumnOrName) -> Column:
    text = _col(c)
    plain = F.translate(text, "$,", "").try_cast("double")
    about = F.regexp_replace(F.regexp_extract(text, fv.MSRP_ABOUT_PATTERN, 1), ",", "").try_cast("double")
    return F.when(text.startswith("$"), plain).otherwise(about)


def matched_number(c: ColumnOrName, pattern: str, default: float = 0.0) -> Column:
    return F.coalesce(extract(c, pattern).try_cast("double"), F.lit(default))


def currency_code(symbol: ColumnOrName, table: dict[str, str] | None = None) -> Column:
    """Code of a currency symbol; an unknown symbol stays as it is."""
    out = _col(symbol)
    for sign, code in (table or fv.CURRENCY_SYMBOLS).items():
        out = F.when(_col(symbol) == sign, code).otherwise(out)
    return out


def fixed_rate_cad(price: ColumnOrName, currency: ColumnOrName) -> Column:
    """Price in CAD at the alert rates; null for any other currency."""
    rate = F.lit(None).cast("double")
    for code, value in fv.ALERT_RATES_TO_CAD.items():
        rate = F.when(_col(currency) == code, value).otherwise(rate)
    return _col(price) * rate


def cpi_adjusted(price: ColumnOrName, cpi: ColumnOrName, latest_cpi: ColumnOrName) -> Column:
    return _col(price) * F.try_divide(_col(latest_cpi), _col(cpi))


def overpriced(price: ColumnOrName, predicted: ColumnOrName, currency: ColumnOrName) -> dict[str, Column]:
    """Amount, percent and text class of a price against its prediction."""
    amount = _col(price) - _col(predicted)
    percent = F.try_divide(amount, _col(predicted)) * 100
    tail = F.concat(
        F.lit("by "), _col(currency), F.lit(" $"), F.format_string("%.2f", F.abs(amount)),
        F.lit(" ("), F.format_string("%.2f", F.when(amount < 0, F.abs(percent)).otherwise(percent)), F.lit("%)"),
    )
    text = (
        F.when(amount > 0, F.concat(F.lit("Overpriced "), tail))
        .when(amount < 0, F.concat(F.lit("Underpriced "), tail))
        .when(amount == 0, F.lit("Priced perfectly"))
    )
    return {"overpriced_by": amount, "overpriced_pct": percent, "price_text": text}


# --- dates ----------------------------------------------------------------

POST_DATE_FORMATS = ["MMM-dd-yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]


def parse_post_date(c: ColumnOrName, formats: list[str] | None = None) -> Column:
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in (formats or POST_DATE_FORMATS)])


def page_time(c: ColumnOrName) -> Column:
    """A time as it stands in a table or on a page; other text gives null."""
    return F.coalesce(_col(c).try_cast("timestamp"), parse_post_date(_col(c).cast("string")))


def month_start(c: ColumnOrName) -> Column:
    return F.trunc(_col(c).cast("date"), "MM")


def calendar_parts(c: ColumnOrName) -> dict[str, Column]:
    day = _col(c).cast("date")
    return {
        "year": F.year(day),
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "year_month": F.date_format(day, "yyyy-MM"),
    }


def whole_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole days from start to end, rounded down like an interval's day part."""
    micros = F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def age_at_post(title: ColumnOrName, description: ColumnOrName, post_date: ColumnOrName) -> Column:
    """Days from 1 January of the model year to the posting, -1000 if unknown."""
    jan1 = F.make_date(model_year(title, description).try_cast("int"), F.lit(1), F.lit(1))
    return F.coalesce(F.date_diff(_col(post_date).cast("date"), jan1), F.lit(fv.UNKNOWN_AGE_DAYS))


def covid_flag(post_date: ColumnOrName) -> Column:
    ts = _col(post_date).cast("timestamp_ntz")
    inside = (ts > F.lit("2020-03-20").cast("timestamp_ntz")) & (ts < F.lit("2022-08-01").cast("timestamp_ntz"))
    return F.when(inside, 1).otherwise(0)


def fixed_offset_instant(c: ColumnOrName, offset: str = "-07:00") -> Column:
    """Read a wall-clock time as standing in a fixed offset and return the instant."""
    return F.to_utc_timestamp(_col(c), offset)


def hours_between(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    micros = F.unix_micros(_col(later).cast("timestamp")) - F.unix_micros(_col(earlier).cast("timestamp"))
    return micros / F.lit(3_600_000_000)


# --- geography ------------------------------------------------------------


def haversine_km(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName) -> Column:
    a, b = F.radians(_col(lat1)), F.radians(_col(lat2))
    half_lat = F.radians(_col(lat2) - _col(lat1)) / 2
    half_lon = F.radians(_col(lon2) - _col(lon1)) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), F.lit(2))
    return F.lit(2 * fv.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
