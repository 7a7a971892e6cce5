"""Brand names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmill.functions.columns import SPACE, WORD, drop_all, first_group, let, strip, unless_blank

# Words of a byline that are not part of the brand.
BYLINE_WORDS = ["Brand:", "Visit the", "Store"]


def trim_symbols(word: Column) -> Column:
    return drop_all(word, rf"\A[^{WORD}]+|[^{WORD}]+\z")


def distinct_words(text: Column) -> Column:
    """Words without symbols at their ends, repetitions removed, in order; NULL when none is left."""
    words = F.transform(F.split(strip(text), f"[{SPACE}]+"), trim_symbols)
    return unless_blank(F.array_join(F.array_distinct(F.filter(words, lambda w: w != "")), " "))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of each run of letters, lower-case the others."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def brand_from_byline(text: Column) -> Column:
    for word in BYLINE_WORDS:
        text = F.replace(text, F.lit(word), F.lit(""))
    return distinct_words(text)


def brand_from_link(href: Column) -> Column:
    slug = F.replace(first_group(href, "/stores/([^/]+)/"), F.lit("-"), F.lit(" "))
    return distinct_words(title_case(slug))


def brand_from_title(title: Column) -> Column:
    word = trim_symbols(F.get(F.split(strip(title), f"[{SPACE}]+"), 0))
    return let(word, lambda w: F.when(F.length(w) > 2, w))


def brand(byline: Column, href: Column, title: Column) -> Column:
    return F.coalesce(brand_from_byline(byline), brand_from_link(href), brand_from_title(title))
