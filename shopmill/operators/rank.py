"""Ranked product links.

Links of one page are ranked inside the page's row, without a shuffle. Tables of links that come from elsewhere
are cut and de-duplicated with aggregates and limited windows that reduce before they shuffle, so a page with a
third of all links does not land in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmill.functions import urls
from shopmill.functions.columns import let, unless_blank, with_computed
from shopmill.operators.extract import find_elements
from shopmill.operators.select import Selector, SelectorSet, attribute, element, first_inside
from shopmill.operators.shred import slice_text
from shopmill.operators.skew import join_unique
from shopmill.plans import vocabulary as v

_PAIRS = [("CSS_SELECTOR", text) for pair in v.SEARCH_FALLBACK for text in pair]
SEARCH = SelectorSet([v.SEARCH_ITEM, v.SPONSORED, v.PRODUCT_LINK], v.SEARCH_RANK, _PAIRS)
BESTSELLERS = SelectorSet([v.BESTSELLER_BADGE, v.BESTSELLER_CARD, v.PRODUCT_LINK], v.BESTSELLER_FALLBACK)
COUNTED = SelectorSet([v.UNSPONSORED_ITEM])


def _asin_at(index: Column) -> Column:
    return unless_blank(F.regexp_extract(attribute(element(index), "href"), urls.ASIN_PATTERN, 1))


def _number_at(index: Column, what: str = "text") -> Column:
    shown = let(element(index), lambda e: slice_text(F.col(what), e, what))
    return unless_blank(F.regexp_extract(shown, r"(\d+)", 1)).try_cast("int")


def _link(rank: Column, pos: Column, asin: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), pos.cast("int").alias("pos"), asin.alias("asin"))


def _first_per_asin(links: Column) -> Column:
    return let(links, lambda ls: F.filter(ls, lambda l, i: F.array_position(ls["asin"], l["asin"]) == i + 1))


def _search_primary(n: int) -> Column:
    """Unsponsored result items by badge rank, else by position among all items; the first ``n``."""

    def ranked(p: Column) -> Column:
        def describe(item: Column, i: Column) -> Column:
            badge = F.coalesce(*(first_inside(p[f"badge{b}"], item) for b in range(len(v.SEARCH_RANK))))
            rank = F.coalesce(_number_at(badge), i + 1)
            return F.struct(
                F.array_contains(p["sponsored"]["outer"], item).alias("sponsored"),
                _link(rank, i + 1, _asin_at(first_inside(p["links"], item))).alias("link"),
            )

        described = F.transform(SEARCH.indexes(v.SEARCH_ITEM), describe)
        kept = F.filter(described, lambda d: d["link"]["asin"].isNotNull() & ~d["sponsored"])
        return F.slice(F.array_sort(F.transform(kept, lambda d: d["link"])), 1, n)

    return let(
        F.struct(
            SEARCH.contained(v.PRODUCT_LINK).alias("links"), SEARCH.contained(v.SPONSORED).alias("sponsored"),
            *(SEARCH.contained(selector).alias(f"badge{b}") for b, selector in enumerate(v.SEARCH_RANK)),
        ),
        ranked,
    )


def _in_order(asins: Column, n: int) -> Column:
    """Links in the order of appearance: distinct, the first ``n``."""
    distinct = F.slice(F.array_distinct(F.filter(asins, lambda a: a.isNotNull())), 1, n)
    return F.transform(distinct, lambda a, i: _link(i + 1, i + 1, a))


def _search_fallbacks(n: int) -> list[Column]:
    def pair(container: str, link: str) -> Column:
        containers = SEARCH.indexes(("CSS_SELECTOR", container))
        return let(
            SEARCH.contained(("CSS_SELECTOR", link)),
            lambda links: F.transform(containers, lambda c: _asin_at(first_inside(links, c))),
        )

    by_pair = [_in_order(pair(container, link), n) for container, link in v.SEARCH_FALLBACK]
    return [*by_pair, _in_order(F.transform(SEARCH.indexes(v.PRODUCT_LINK), _asin_at), n)]


def _bestsellers(selector: Selector, around: Callable[[Column, Column], Column], what: str) -> Column:
    """Badge rank and the first link of the element that ``around(badge, links)`` gives for the badge."""

    def describe(links: Column, badge: Column, i: Column) -> Column:
        return _link(_number_at(badge, what), i + 1, _asin_at(first_inside(links, around(badge, links))))

    found = let(
        BESTSELLERS.contained(v.PRODUCT_LINK),
        lambda links: F.transform(BESTSELLERS.indexes(selector), lambda badge, i: describe(links, badge, i)),
    )
    return F.array_sort(F.filter(found, lambda l: l["asin"].isNotNull() & l["rank"].isNotNull()))


def _nearest_card(badge: Column, links: Column) -> Column:
    """The badge itself or the nearest element around it that is a card."""
    line = F.concat(element(badge)["up"], F.array(badge))
    cards = BESTSELLERS.indexes(v.BESTSELLER_CARD)
    return F.array_max(F.filter(line, lambda a: F.array_contains(cards, a)))


def _nearest_with_link(badge: Column, links: Column) -> Column:
    """The nearest of five ancestors that holds a link."""
    depth = element(badge)["depth"]
    near = F.filter(element(badge)["up"], lambda a: depth - element(a)["depth"] <= v.BESTSELLER_CLIMB)
    return F.array_max(F.filter(near, lambda a: F.array_contains(links["outer"], a)))


def _bestseller_lists(fallback: bool) -> list[Column]:
    first = _bestsellers(v.BESTSELLER_BADGE, _nearest_card, "text")
    others = v.BESTSELLER_FALLBACK if fallback else []
    return [first, *(_bestsellers(selector, _nearest_with_link, "shown") for selector in others)]


def _first_filled(lists: list[Column]) -> Column:
    """The first list with a link, and its place among the lists (0 is the primary one)."""

    def unless_empty(links: Column, place: int) -> Column:
        return let(links, lambda ls: F.when(F.size(ls) > 0, F.struct(F.lit(place).alias("source"), ls.alias("links"))))

    filled = [unless_empty(links, place) for place, links in enumerate(lists)]
    return F.coalesce(*filled)


def _ranked_rows(lists: DataFrame) -> DataFrame:
    return lists.select("page_id", F.col("p.source").alias("source"), F.explode("p.links").alias("l")).select(
        "page_id", "source", "l.*", urls.product_url(F.col("l.asin")).alias("url")
    )


def search_link_lists(
    pages: DataFrame, n: int = 10, fallback: bool = True, distinct: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per search page: ``page_id``, the columns to ``keep``, and ``p``, the source and list of its links.

    ``p`` is NULL for a page without links.
    """
    primary = _search_primary(n)
    lists = [_first_per_asin(primary) if distinct else primary, *(_search_fallbacks(n) if fallback else [])]
    found = find_elements(pages.select("page_id", *keep, "html"), SEARCH)
    return with_computed(found, "p", _first_filled(lists)).select("page_id", *keep, "p")


def search_links(pages: DataFrame, n: int = 10, fallback: bool = True, distinct: bool = True) -> DataFrame:
    """Ranked links of search pages: ``page_id, source, rank, pos, asin, url``.

    The cut to ``n`` comes before repeated products are removed, so fewer than ``n`` can remain. ``source`` 0 is
    the result list, 1 to 5 are the fallbacks, used only for a page on which all earlier sources are empty.
    """
    return _ranked_rows(search_link_lists(pages, n, fallback, distinct))


def bestseller_links(pages: DataFrame, n: int = 10, fallback: bool = True) -> DataFrame:
    """Ranked links of best-seller pages, the first ``n`` by rank; a repeated product is kept here."""
    found = find_elements(pages.select("page_id", "html"), BESTSELLERS, levels=v.BESTSELLER_CLIMB)
    lists = [F.slice(links, 1, n) for links in _bestseller_lists(fallback)]
    return _ranked_rows(with_computed(found, "p", _first_filled(lists)).select("page_id", "p"))


def result_counts(pages: DataFrame, n: int = 10) -> DataFrame:
    """Unsponsored result items per search page, and whether they are enough for a list of ``n``."""
    items = F.size(COUNTED.indexes(v.UNSPONSORED_ITEM))
    return find_elements(pages.select("page_id", "html"), COUNTED).select(
        "page_id", items.alias("items"), (items >= n).alias("enough")
    )


def limit_ranked(links: DataFrame, n: int, key: str = "page_id") -> DataFrame:
    """First ``n`` links per page by rank, then position."""
    by_rank = Window.partitionBy(key).orderBy("rank", "pos")
    return links.withColumn("place", F.row_number().over(by_rank)).filter(F.col("place") <= n)


def first_per_asin(links: DataFrame, key: str = "page_id") -> DataFrame:
    """The best-ranked link of each product per page."""
    best = F.min(F.struct("rank", "pos")).alias("best")
    return links.groupBy(key, "asin").agg(best).select(key, "asin", "best.rank", "best.pos")


def use_fallback(primary: DataFrame, fallback: DataFrame, key: str = "page_id") -> DataFrame:
    """All primary links, and the fallback links of pages that have no primary link."""
    return primary.unionByName(join_unique(fallback, primary.select(key).distinct(), key, "left_anti"))


def check_ranks(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page, whether the ranks in list order (by ``pos``) are exactly 1, 2, 3 and so on.

    Ranks are 1 to n in order when there are n different ones between 1 and n, and each link stands after the one
    ranked just before it. That needs no sort of a whole page: the neighbours meet in a join on page and rank.
    """
    by_rank = links.groupBy(key, "rank").agg(
        F.count("*").alias("copies"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )
    following = by_rank.select(key, (F.col("rank") - 1).alias("rank"), F.col("first_pos").alias("next_pos"))
    pairs = by_rank.join(following, [key, "rank"], "left")
    return pairs.groupBy(key).agg(
        F.sum("copies").alias("links"),
        (
            (F.min("rank") == 1)
            & (F.max("rank") == F.sum("copies"))
            & (F.count("*") == F.sum("copies"))
            & F.bool_and(F.coalesce(F.col("last_pos") < F.col("next_pos"), F.lit(True)))
        ).alias("in_order"),
    )


def count_links(links: DataFrame, key: str = "page_id") -> DataFrame:
    return links.groupBy(key).agg(F.count("*").alias("links"), F.countDistinct("asin").alias("products"))
