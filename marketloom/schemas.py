"""Column definitions of the stored tables; jobs never infer a schema."""

LISTING = """url string, category string, category_num int, region_code int, ad_title string, description string,
price double, currency string, location string, condition string, frame_size string, wheel_size string,
material string, front_travel string, rear_travel string, restrictions string, still_for_sale string,
view_count string, watch_count string, original_post_date string, last_repost_date string,
datetime_scraped timestamp, extra map<string,string>"""

CHANGE = """url string, category string, category_num int, field string, old_value string, new_value string,
update_date string"""

ALERT = """uuid string, alert_name string, category_num int, search_string string, price_search_string string,
last_checked timestamp, email_stem string, email_domain string"""

CPI_US = "series_id string, year int, period string, cpi double, footnote string"
CPI_CANADA = "REF_DATE string, `Products and product groups` string, VALUE double"
SPEC_LINKS = "URL string"

DATA_TYPES = {"base": LISTING, "sold": LISTING, "changes": CHANGE}
