"""Sizes and colours mentioned in a description.

Java's regex engine keeps a stack frame per repetition of a greedy group, so a list of thousands of items in
one hostile text could end a whole job. The size lists therefore repeat possessively (nothing after them ever
asks for an item back, so the result is the same), and the colour list has no repeated group at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmill.functions.columns import SPACE, strip

# Size names and the colour shown when a description names none.
LETTER_SIZES = "X?S|X?M|X?L|XXL|XXXL|2XL|3XL|4XL|5XL"
WORD_SIZES = "Small|Medium|Large|X-Large|XX-Large"
DEFAULT_COLOR = "As shown in the figure"

NUMBER = r"\d+(?:\.\d+)?"


def _list_of(item: str) -> str:
    return rf"((?:{item})(?:[{SPACE}]*+,[{SPACE}]*+(?:{item}))*+)"


SIZE_LISTS = [
    rf"(?iu)Size:?[{SPACE}]*" + _list_of(LETTER_SIZES),
    rf"(?iu)Available sizes?:?[{SPACE}]*" + _list_of(NUMBER),
    rf"(?iu)Sizes?(?:[{SPACE}]+available)?:?[{SPACE}]*" + _list_of(WORD_SIZES),
]
COLOR_LISTS = [
    rf"(?iud){prefix}colou?rs?:?[{SPACE}]*([A-Z](?:[A-Z,{SPACE}]*[A-Z])?)(?:\.|$|\n)"
    for prefix in ["", "Available "]
]


def _items(text: Column, patterns: list[str]) -> Column:
    lists = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))
    items = F.transform(F.flatten(F.transform(lists, lambda m: F.split(m, ","))), strip)
    return F.array_sort(F.array_distinct(items))


def sizes(description: Column) -> Column:
    """Sorted distinct sizes; an empty array when there is no description or it names none."""
    return F.coalesce(_items(description, SIZE_LISTS), F.array().cast("array<string>"))


def colors(description: Column) -> Column:
    # An empty item ends a list: mark it with a character that no list can contain.
    marked = F.regexp_replace(description, rf",(?=[{SPACE}]*,)", "\u0000")
    return F.coalesce(_items(marked, COLOR_LISTS), F.array().cast("array<string>"))
