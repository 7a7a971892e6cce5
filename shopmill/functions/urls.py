"""URL and category scalars, and the two page predicates that look at URLs or raw HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmill.functions.columns import first_group

# URL shapes, host names, default names and the throttle sentence.
SEARCH_URL_HEAD = "https://www.amazon.com/s?k="
SEARCH_URL_TAIL = "&s=exact-aware-popularity-rank&language=en_US&currency=USD"
PRODUCT_URL_HEAD = "https://www.amazon.com/dp/"
SHOP_HOST = "amazon.com"
REGIONAL_HOSTS = ["amazon.cn", "amazon.co.jp", "amazon.co.uk"]
LANGUAGE_SWITCH = "/gp/switch-language"
ASIN_PATTERN = "/dp/([A-Z0-9]{10})"
TERM_PATTERN = "k=([^&]+)"
BESTSELLER_PATTERN = r"Best-Sellers-([^\n]*?)/zgbs"
DEFAULT_SEARCH_CATEGORY = "Search_Results"
DEFAULT_BESTSELLER_CATEGORY = "Amazon_Bestsellers"
UNSAFE_FILE_CHARACTERS = r'[<>:"/\\|?*]'
THROTTLE_SENTENCE = "Request was throttled. Please wait a moment and refresh the page"


def quote_plus(term: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    encoded = F.url_encode(term)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def percent_decode(text: Column) -> Column:
    """Decode %XX escapes; a plus sign and a malformed escape stay as they are."""
    guarded = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))


def search_url(term: Column) -> Column:
    return F.concat(F.lit(SEARCH_URL_HEAD), quote_plus(term), F.lit(SEARCH_URL_TAIL))


def rewrite_host(url: Column) -> Column:
    for host in REGIONAL_HOSTS:
        url = F.replace(url, F.lit(host), F.lit(SHOP_HOST))
    return url


def unwrap_url(link: Column, is_struct: bool) -> Column:
    """URL of a link column that is either a string or a struct with a ``url`` field."""
    return link["url"] if is_struct else link


def extract_asin(url: Column) -> Column:
    return first_group(url, ASIN_PATTERN)


def product_url(asin: Column) -> Column:
    return F.concat(F.lit(PRODUCT_URL_HEAD), asin)


def category_from_search_url(url: Column) -> Column:
    decoded = F.replace(percent_decode(first_group(url, TERM_PATTERN)), F.lit("+"), F.lit(" "))
    return F.coalesce(decoded, F.lit(DEFAULT_SEARCH_CATEGORY))


def category_from_bestseller_url(url: Column) -> Column:
    """NULL when the URL does not name a category (an empty name counts as a name)."""
    return F.when(url.rlike(BESTSELLER_PATTERN), percent_decode(F.regexp_extract(url, BESTSELLER_PATTERN, 1)))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, UNSAFE_FILE_CHARACTERS, "_")


def is_throttled(html: Column) -> Column:
    return F.contains(html, F.lit(THROTTLE_SENTENCE))


def is_redirected(final_url: Column) -> Column:
    return ~F.contains(final_url, F.lit(SHOP_HOST)) | F.contains(final_url, F.lit(LANGUAGE_SWITCH))
