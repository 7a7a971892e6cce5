"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bodies of Java character classes that accept the characters which Unicode-aware \s and \w accept.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"

WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def unless_blank(text: Column) -> Column:
    """Like ``blank_to_null``, for a costly text inside a lambda, where it would otherwise be computed twice."""
    return F.get(F.filter(F.array(text), lambda t: t != ""), 0)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when nothing matches (or the group is empty)."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def drop_all(text: Column, *patterns: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    The optimizer may copy an ordinary column into each filter and projection that uses it; it does not copy what a
    generator gives.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
