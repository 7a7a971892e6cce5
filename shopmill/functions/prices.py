"""Numbers read from price, savings, rating and review texts. Money never passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmill.functions.columns import SPACE, first_group
from shopmill.schemas import MONEY

SOURCE_PRICE_PATTERN = rf'"price":[{SPACE}]*"?\$?(\d+\.?\d*)"?'
# Digit groups repeat possessively: any other repetition costs the regex engine one stack frame per group. A match
# never starts inside a list of groups: it would end where the whole list ends, so trying is only quadratic.
REVIEW_PATTERN = rf"(?<!\d)(?<!\d,)(\d++(?:,\d++)*+)[{SPACE}]*(?:[^\d\n]*[{SPACE}]+)?ratings?"


def parse_price(text: Column) -> Column:
    """First number of a text such as ``$1,299.00``, with two decimals."""
    compact = F.regexp_replace(text, rf"[{SPACE}$,]+", "")
    return first_group(compact, r"(\d+\.?\d*)").try_cast(MONEY)


def parse_percentage(text: Column) -> Column:
    return first_group(text, r"(\d+(?:\.\d+)?)").try_cast("decimal(5,2)")


def price_in_source(html: Column) -> Column:
    """First price of the data embedded in a page source."""
    return parse_price(F.regexp_extract(html, SOURCE_PRICE_PATTERN, 1))


def rating_from_class(class_text: Column) -> Column:
    stars = first_group(class_text, r"a-star-(\d-\d|\d)")
    return F.replace(stars, F.lit("-"), F.lit(".")).try_cast("double")


def rating_from_text(text: Column) -> Column:
    return first_group(text, r"([\d.]+) out of 5").try_cast("double")


def review_count(text: Column) -> Column:
    return F.replace(first_group(text, REVIEW_PATTERN), F.lit(","), F.lit("")).try_cast("bigint")


def money_text(amount: Column) -> Column:
    return amount.cast("string")
