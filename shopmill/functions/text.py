"""Cleaning of description text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmill.functions.columns import SPACE, WORD, drop_all, let, strip, unless_blank

# Phrases that carry no description, in the order in which they are removed.
BOILERPLATE = [
    "Read more",
    "Show more",
    "See more",
    "Click to open expanded view",
    "Scroll left/right to see more",
    "Roll over image to zoom in",
]

# Code fragments to remove, in order (Java dialect), and marks of text that is still code.
CODE_FRAGMENTS = [
    r"<script[\s\S]*?</script>",
    r"<style[\s\S]*?</style>",
    rf"function[{SPACE}]*[{WORD}]*[{SPACE}]*\{{[\s\S]*?\}}",
    rf"var[{SPACE}]+[{WORD}]+[{SPACE}]*=",
    rf"\.[{WORD}-]+[{SPACE}]*\{{[^}}]*\}}",
    r"/\*[\s\S]*?\*/",
    r"//.*",
    r"console\.log\(.*?\)",
    r"document\..*?;",
    r"window\..*?;",
    r"\$\(.*?\)",
]
CODE_MARKS = [
    "function(", "return", "var ", "let ", "const ", "=>",
    "{", "}", ";", "if(", "for(", "while(",
]


def clean_text(text: Column) -> Column:
    """One line of plain prose, a new line after each sentence end, without boilerplate phrases."""
    text = F.regexp_replace(strip(text), f"[{SPACE}]+", " ")
    text = F.regexp_replace(text, f"[^{WORD}{SPACE}" + r""".,;:!?()'"\-–—/]""", "")
    text = F.regexp_replace(text, r"([.,!?])\1+", "$1")
    text = F.regexp_replace(text, rf"([.!?])[{SPACE}]*([{WORD}])", "$1\n$2")
    text = drop_all(text, *(f"(?iu){phrase}" for phrase in BOILERPLATE))
    return unless_blank(strip(text))


def filter_code(text: Column) -> Column:
    """Remove code fragments and blank lines; NULL when the rest still looks like code."""
    text = drop_all(text, *(f"(?iud){fragment}" for fragment in CODE_FRAGMENTS))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    def keep_prose(joined: Column) -> Column:
        code = reduce(lambda a, b: a | b, (F.contains(joined, F.lit(mark)) for mark in CODE_MARKS))
        return F.when(~code & (joined != ""), joined)

    return let(F.array_join(lines, "\n"), keep_prose)


def truncate_text(text: Column, limit: int) -> Column:
    """Cut a text longer than ``limit`` after its last whole section, else its last whole sentence."""
    def cut(head: Column, backwards: Column) -> Column:
        def end_after(separator: str) -> Column:
            found = F.instr(backwards, separator[::-1])
            end = F.length(head) - found + 1
            return F.when((found > 0) & (end > len(separator)), end)

        ends = (end_after(separator) for separator in ["\n\n", ". ", "! ", "? "])
        return strip(F.substring(head, F.lit(1), F.coalesce(*ends, F.lit(limit))))

    def shorten(whole: Column) -> Column:
        short = let(F.substring(whole, 1, limit), lambda head: let(F.reverse(head), lambda b: cut(head, b)))
        return F.when(F.length(whole) > limit, short).otherwise(whole)

    return let(text, shorten)


def short_description(description: Column, limit: int = 100) -> Column:
    """First ``limit`` characters without tags, cut at a word boundary; empty when there is no description."""
    def shorten(plain: Column) -> Column:
        def at_word(head: Column) -> Column:
            found = F.instr(F.reverse(head), " ")
            whole_words = F.when((found > 0) & (found < F.length(head)), F.length(head) - found)
            cut = F.substring(head, F.lit(1), F.coalesce(whole_words, F.length(head)))
            return F.when(F.length(plain) > limit, F.concat(cut, F.lit("..."))).otherwise(head)

        return let(strip(F.substring(plain, 1, limit)), at_word)

    return F.coalesce(let(F.regexp_replace(description, "<[^>]+>", ""), shorten), F.lit(""))
