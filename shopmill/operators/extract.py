"""Product pages to product records: one narrow pass, no shuffle.

HTML is read once and dropped at the first step. The element chains of all fields are evaluated on the short
array of elements that any selector asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmill.functions import brands, prices, urls
from shopmill.functions import text as texts
from shopmill.functions.columns import let, strip, unless_blank, with_computed
from shopmill.operators.select import Selector, SelectorSet, attribute, safe_text
from shopmill.operators.shred import shred
from shopmill.plans import vocabulary as v
from shopmill.schemas import PRICE


BODY = ("CSS_SELECTOR", "body")
SECTIONS = [("ID", key) for key, _ in v.DESCRIPTION_SECTIONS]
CURRENT_PRICE = [*v.CURRENT_PRICE, *v.WHOLE_PRICE, *v.PRICE_FRACTION]
# What each field of a product record is read from; title and current price decide whether there is a record.
FIELD_SELECTORS = {
    "title": v.TITLE,
    "price": [*CURRENT_PRICE, *v.ORIGINAL_PRICE, *v.SAVINGS_AMOUNT],
    "rating": [*v.RATING_CLASS, *v.RATING_TEXT],
    "review_count": [BODY],
    "description": SECTIONS,
    "image_url": v.IMAGE,
    "brand": v.BRAND,
    "availability": [
        *v.CART_BUTTONS, *v.PRICE_ELEMENTS, *v.OUT_OF_STOCK, *v.PREORDER, *v.AVAILABILITY_ANY_TEXT, *v.CART_LIKE,
        *v.PRICE_LIKE,
    ],
}
ALTERNATIVE = SelectorSet(v.ALTERNATIVE_PRICE)


def split_throttled(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that can be read, and pages to fetch again."""
    throttled = F.coalesce(urls.is_throttled(F.col("html")), F.lit(False))
    return pages.filter(~throttled), pages.filter(throttled)


def find_elements(pages: DataFrame, selectors: SelectorSet, levels: int = 0) -> DataFrame:
    """Pages with their ``elements`` and the ``hits`` of the selectors among them; ``html`` is gone."""
    return with_computed(shred(pages, selectors.probes, levels), "hits", selectors.hits())


class ProductFields:
    """Columns of a product record over pages whose elements have been found."""

    def __init__(self, chosen: SelectorSet) -> None:
        self.chosen = chosen

    def exists(self, selectors: list[Selector]) -> Column:
        return self.chosen.first(selectors).isNotNull()

    def text(self, selectors: list[Selector]) -> Column:
        """Text of the first element that a chain finds, whether or not it is empty."""
        return strip(self.chosen.first_text(selectors))

    def title(self) -> Column:
        return unless_blank(strip(self.chosen.first_text(v.TITLE, visible=True)))

    def image_url(self) -> Column:
        return self.chosen.first_attribute(v.IMAGE, "src", visible=True)

    def current_price(self) -> Column:
        pieces = F.concat(self.text(v.WHOLE_PRICE), self.text(v.PRICE_FRACTION))
        return F.coalesce(prices.parse_price(F.coalesce(self.text(v.CURRENT_PRICE), pieces)), F.col("source_price"))

    def price(self, current: Column) -> Column:
        """Price record; the parts that pages never give stay NULL."""
        nothing = F.lit(None)
        return F.struct(
            current.alias("current_price"),
            prices.parse_price(self.text(v.ORIGINAL_PRICE)).alias("original_price"),
            nothing.alias("deal_price"),
            F.struct(nothing.alias("min"), nothing.alias("max")).alias("price_range"),
            F.struct(
                prices.parse_price(self.text(v.SAVINGS_AMOUNT)).alias("amount"),
                prices.parse_percentage(self.text(v.SAVINGS_PERCENTAGE)).alias("percentage"),
            ).alias("savings"),
            nothing.alias("prime_price"),
            nothing.alias("installment"),
            nothing.alias("coupon"),
        ).cast(PRICE)

    def rating(self) -> Column:
        return F.coalesce(
            prices.rating_from_class(self.chosen.first_attribute(v.RATING_CLASS, "class")),
            prices.rating_from_text(self.chosen.first_text(v.RATING_TEXT)),
        )

    def review_count(self) -> Column:
        return prices.review_count(F.coalesce(self.chosen.first_text([BODY], "shown"), F.col("shown")))

    def description(self, limit: int) -> Column:
        """Cleaned sections in fixed order, equal contents once, cut at a section or sentence end."""

        def section(key: str, label: str) -> Column:
            shown = unless_blank(self.chosen.first_text([("ID", key)], "shown"))
            content = F.coalesce(shown, self.chosen.first_text([("ID", key)]))
            return F.struct(F.lit(label).alias("label"), content.alias("content"))

        raw = F.array(*(section(key, label) for key, label in v.DESCRIPTION_SECTIONS))
        clean = F.transform(
            raw, lambda s: F.struct(s["label"], texts.filter_code(texts.clean_text(s["content"])).alias("content"))
        )
        kept = F.filter(clean, lambda s: s["content"].isNotNull())
        parts = let(
            kept,
            lambda all_: F.transform(
                F.filter(all_, lambda s, i: F.array_position(all_["content"], s["content"]) == i + 1),
                lambda s: F.concat(s["label"], F.lit(":\n"), s["content"]),
            ),
        )
        return texts.truncate_text(unless_blank(F.array_join(parts, "\n\n")), limit)

    def brand(self, title: Column) -> Column:
        byline = self.chosen.first_text(v.BRAND, visible=True)
        return brands.brand(byline, self.chosen.first_attribute(v.BRAND, "href", visible=True), title)

    def availability(self, current_price: Column) -> Column:
        def usable(button: Selector) -> Column:
            return self.exists([button]) & self.chosen.first_attribute([button], "disabled").isNull()

        in_stock = F.lit(v.IN_STOCK)
        firsts = F.array(*(self.chosen.first_text([s], "shown") for s in v.AVAILABILITY_ANY_TEXT))
        first_text = F.get(F.filter(F.transform(firsts, strip), lambda t: t != ""), 0)
        return F.coalesce(
            *(F.when(usable(button), in_stock) for button in v.CART_BUTTONS),
            F.when(self.exists(v.PRICE_ELEMENTS), in_stock),
            F.when(self.exists(v.OUT_OF_STOCK), F.lit(v.UNAVAILABLE)),
            F.when(self.exists(v.PREORDER), F.lit(v.PREORDERABLE)),
            unless_blank(self.text(v.AVAILABILITY_TEXT)),
            F.when(current_price.isNotNull(), in_stock),
            first_text,
            F.when(self.exists(v.CART_LIKE) | self.exists(v.PRICE_LIKE), in_stock),
            F.lit(v.UNKNOWN_STATUS),
        )


def alternative_prices(pages: DataFrame) -> DataFrame:
    """The other way to read the current price: ``page_id, price``."""

    def read(selectors: list[Selector]) -> Column:
        return prices.parse_price(ALTERNATIVE.first_text(selectors))

    tries = [v.ALTERNATIVE_PRICE, *([selector] for selector in v.ALTERNATIVE_PRICE_RETRY)]
    found = find_elements(pages.select("page_id", "html"), ALTERNATIVE)
    return found.select("page_id", F.coalesce(*map(read, tries)).alias("price"))


def content_type_column(element: Column) -> Column:
    """Kind of content that an element (or else its parent) announces by id or class."""

    def kind(e: Column) -> Column:
        marks = F.lower(F.concat_ws("\n", e["id"], attribute(e, "class")))
        return F.coalesce(*(F.when(F.contains(marks, F.lit(key)), F.lit(label)) for key, label in v.CONTENT_TYPES))

    parent = F.get("elements", F.try_element_at(element["up"], F.lit(-1)))
    return F.coalesce(kind(element), let(parent, kind))


def content_types(pages: DataFrame, selectors: list[Selector]) -> DataFrame:
    """Kind of content of every element that the selectors find: ``page_id, pos, content_type``."""
    chosen = SelectorSet(selectors)
    found = find_elements(pages.select("page_id", "html"), chosen, levels=1)
    each = F.transform(
        chosen.first_filled(selectors), lambda e: F.struct(e["pos"].alias("pos"), content_type_column(e).alias("kind"))
    )
    return with_computed(found, "each", each).select("page_id", F.explode("each").alias("c")).select(
        "page_id", "c.pos", F.col("c.kind").alias("content_type")
    )


def extract_products(
    pages: DataFrame,
    category: Column | None = None,
    at: Column | None = None,
    description_limit: int = 32000,
    fields: list[str] | None = None,
) -> DataFrame:
    """Product records of stored pages: ``page_id`` and the product columns.

    Throttled pages and pages with neither title nor price give no record. ``category`` may use any column of
    ``pages``; ``at`` is the time to stamp on the records, given by the caller so that a rerun repeats them. With
    ``fields`` only the selectors of these fields are tried, and only their columns are given.
    """
    wanted = list(FIELD_SELECTORS) if fields is None else fields
    chosen = SelectorSet(v.TITLE, CURRENT_PRICE, *(FIELD_SELECTORS[name] for name in wanted))
    read = ProductFields(chosen)
    readable, _ = split_throttled(pages)
    stamped = readable.select(
        "page_id",
        "url",
        (F.lit(None).cast("string") if category is None else category).alias("category"),
        (F.lit(None).cast("timestamp") if at is None else at.cast("timestamp")).alias("timestamp"),
        # the one value that needs the raw HTML
        prices.price_in_source(F.col("html")).alias("source_price"),
        "html",
    )
    found = find_elements(stamped, chosen)
    essential = F.array(F.struct(read.title().alias("title"), read.current_price().alias("current_price")))
    kept = F.filter(essential, lambda r: r["title"].isNotNull() | r["current_price"].isNotNull())
    records = found.select("*", F.explode(kept).alias("r"))
    title, current_price = F.col("r.title"), F.col("r.current_price")
    columns = {
        "title": lambda: title,
        "price": lambda: read.price(current_price),
        "rating": read.rating,
        "review_count": read.review_count,
        "description": lambda: read.description(description_limit),
        "image_url": read.image_url,
        "brand": lambda: read.brand(title),
        "availability": lambda: read.availability(current_price),
    }
    return records.select(
        "page_id",
        "url",
        urls.extract_asin(F.col("url")).alias("asin"),
        *(make().alias(name) for name, make in columns.items() if name in wanted),
        "category",
        "timestamp",
    )


def page_categories(pages: DataFrame) -> DataFrame:
    """Category of best-seller pages: from the URL, else from the page, else the default."""
    selectors = SelectorSet(v.CATEGORY)
    named = strip(selectors.first_text(v.CATEGORY, "shown"))
    return find_elements(pages.select("page_id", "url", "html"), selectors).select(
        "page_id",
        "url",
        F.coalesce(
            urls.category_from_bestseller_url(F.col("url")), named, F.lit(urls.DEFAULT_BESTSELLER_CATEGORY)
        ).alias("category"),
    )


def select_elements(pages: DataFrame, selectors: list[Selector], chain: bool = True) -> DataFrame:
    """One row per element that the selectors find on each page, for any list of selectors.

    With ``chain`` the first selector that has a match gives all its elements; otherwise every selector does, and
    ``priority`` tells which (1 is the first).
    """
    chosen = SelectorSet(selectors)
    found = find_elements(pages.select("page_id", "html"), chosen)
    if chain:
        picked = with_computed(found, "picked", chosen.first_filled(selectors))
        rows = picked.select("page_id", "text", F.explode("picked").alias("e"))
        keys = ["page_id"]
    else:
        by_selector = found.select("page_id", "text", "elements", F.posexplode("hits").alias("at", "found"))
        rows = by_selector.select(
            "page_id",
            "text",
            (F.col("at") + 1).alias("priority"),
            F.explode(F.transform("found", lambda i: F.get("elements", i))).alias("e"),
        )
        keys = ["page_id", "priority"]
    return rows.select(*keys, F.col("e").dropFields("up").alias("e"), "text").select(
        *keys, "e.*", safe_text(F.col("text"), F.col("e")).alias("text")
    )
