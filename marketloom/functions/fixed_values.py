"""Lookup tables, word lists and constants that results depend on."""

# Country -> price-index region.
COUNTRY_TO_CPI_REGION = {
    "United States": "united-states",
    "Canada": "canada",
    "United Kingdom": "uk",
    "Wales": "uk",
    "Ireland": "uk",
    "Northern Ireland": "uk",
    "Scotland": "uk",
    "Germany": "eu",
    "France": "eu",
    "Spain": "eu",
    "Italy": "eu",
    "Netherlands": "eu",
    "Belgium": "eu",
    "Austria": "eu",
    "Portugal": "eu",
    "Greece": "eu",
    "Sweden": "eu",
    "Denmark": "eu",
    "Finland": "eu",
    "Luxembourg": "eu",
    "Slovenia": "eu",
    "Slovakia": "eu",
    "Estonia": "eu",
    "Cyprus": "eu",
    "Malta": "eu",
    "Latvia": "eu",
    "Lithuania": "eu",
    "Czech Republic": "eu",
    "Poland": "eu",
    "Hungary": "eu",
    "Romania": "eu",
    "Bulgaria": "eu",
    "Croatia": "eu",
    "Norway": "eu",
    "Switzerland": "eu",
    "Iceland": "eu",
    "Liechtenstein": "eu",
    "Ukraine": "eu",
}

# Frame size label -> normalised size.
FRAME_SIZES = {
    "XS": "XS", "S": "S", "M": "M", "L": "L", "XL": "XL", "XXL": "XL",
    "43cm": "XS", "44cm": "XS", "45cm": "XS", "46cm": "XS", "47cm": "XS", "48cm": "XS", "49cm": "XS",
    "50cm": "S", "51cm": "S", "52cm": "S",
    "53cm": "M", "54cm": "M", "55cm": "M",
    "56cm": "L", "57cm": "L", "58cm": "L",
    "59cm": "XL", "60cm": "XL", "61cm": "XL", "62cm": "XL", "63cm": "XL", "64cm": "XL", "65cm": "XL",
    '12"': "XS", '13"': "XS", '14"': "XS",
    '15"': "S", '15.5"': "S", '16"': "S", '16.5"': "S",
    '17"': "M", '17.5"': "M", '18"': "M", '18.5"': "M",
    '19"': "L", '19.5"': "L", '20"': "L", '20.5"': "L",
    '21"': "XL", '21.5"': "XL", '22"': "XL", '22.5"': "XL", '23"': "XL", '24"': "XL",
    '25"': "XL", '26"': "XL", '27"': "XL", '28"': "XL",
}

# Currency symbol -> code.
CURRENCY_SYMBOLS = {
    "$": "USD",
    "€": "EUR",
    "£": "GBP",
    "¥": "JPY",
    "₣": "CHF",
    "C$": "CAD",
    "A$": "AUD",
    "kr": "SEK",
    "₹": "INR",
    "₽": "RUB",
}

# Symbols known to the second page layout.
LAYOUT_B_SYMBOLS = {"€": "EUR", "£": "GBP", "$": "USD"}

# Rates used by saved alerts.
ALERT_RATES_TO_CAD = {"USD": 1.25, "GBP": 1.74, "EUR": 1.49, "CAD": 1.0}

# Words that exclude a category although it names a bike.
CATEGORY_EXCLUDED_WORDS = ["parts", "frames", "bags", "racks", "stands", "rims", "mx"]

# Price plausibility.
PRICE_FLOOR = 100
PRICE_CEILING = 20000
JOKE_PRICES = [123, 1234, 12345]
FORBIDDEN_PHRASES = ["stolen", "looking for"]

# Patterns.
MODEL_YEAR_PATTERN = r"((?:19|20)\d{2})"
COUNTRY_PATTERN = r", ([A-Za-z\s]+)"
KNOWN_COUNTRY_PATTERN = "(Canada|United States|United Kingdom)"
PRICE_CURRENCY_PATTERN = r"([\d,]+)\s*([A-Za-z]{1,3})"
SYMBOL_PRICE_PATTERN = r"(\D*)(\d[\d.,]*)(\D*)"
FIRST_NUMBER_PATTERN = r"\d*\.?\d+"
MSRP_ABOUT_PATTERN = r".*about \$([0-9,\.]+).*"
WEIGHT_PATTERN = r"([0-9]+\.[0-9]+)"
FRONT_TRAVEL_PATTERN = r"([0-9]+)mm front"
REAR_TRAVEL_PATTERN = r"([0-9]+)mm rear"
SPEC_URL_PATTERN = r"bikes/(.*)/(.*)/(.*)"
PRICE_MENTION_PATTERN = "[$][0-9]+[.]"
TOKEN_PATTERN = r"[a-zA-Z0-9$&+,:;=?@#|<>^%!]+|[0-9$&+,.:;=?@#|<>^%!]+"
BLOCKED_PAGE_TEXT = "you have been blocked"

# Ordered shipping labels, first match wins.
SHIPPING_LABELS = [
    ("Local pickup", "local_pickup_only"),
    ("within country", "within_country"),
    ("within continent", "within_continent"),
    ("globally", "globally"),
    ("ship locally", "ship_locally"),
]

# Listing columns watched for changes.
WATCHED_COLUMNS = ["price", "description", "ad_title", "category", "currency"]

# Alert mail columns.
ALERT_COLUMNS = [
    "url", "ad_title", "price", "price_change", "pred_price", "pred_price_diff",
    "original_post_date", "location", "last_repost_date", "datetime_scraped",
]

EARTH_RADIUS_KM = 6371
RECENT_HOURS = 48
UNKNOWN_AGE_DAYS = -1000
