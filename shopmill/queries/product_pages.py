"""Product pages written from the part table, and the queries that read their fields back.

The checking SQL computes each field from ``part`` and never sees the HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmill.functions.columns import with_computed
from shopmill.functions.prices import money_text
from shopmill.operators.extract import alternative_prices, content_types, extract_products
from shopmill.operators.select import SelectorSet
from shopmill.operators.shred import shred
from shopmill.plans import vocabulary as v
from shopmill.queries.registry import dealt_table, query

_KEY = "p_partkey"
_TEN = "cast(cast(p_retailprice AS decimal(12,2)) * 10 AS decimal(12,2))"

_PIECES = [
    # title, also as a hidden first match that the chain must pass over
    """if(p_partkey % 9 = 0, '<div style="display: none"><h1 class="a-text-normal">Hidden</h1></div>', '')""",
    """if(p_partkey % 9 = 0, concat('<span class="nav-search-label">', title, '</span>'),
        concat('<span id="productTitle">\\n  ', title, ' </span>'))""",
    # byline
    """CASE p_partkey % 4
        WHEN 0 THEN concat('<a id="bylineInfo" href="/stores/Other/page">Visit the ', p_brand, ' Store</a>')
        WHEN 1 THEN concat('<a id="bylineInfo" href="/stores/o\\'neil-', lower(p_type), '-co/page"> Store </a>')
        ELSE '' END""",
    # prices
    """CASE p_partkey % 6
        WHEN 0 THEN concat('<span class="a-price"><span class="a-offscreen">', money, '</span></span>',
            '<b class="priceBlockSavingsString">$12.50 (5%)</b>')
        WHEN 1 THEN concat('<span class="a-price"><span class="a-offscreen"> ', money, ' </span></span>',
            '<span class="a-price a-text-price" data-a-strike="true"><span class="a-offscreen">', strike,
            '</span></span><span class="savingsPercentage">-', p_size, '%</span>')
        WHEN 2 THEN concat('<span class="a-price-whole">', split(money, '[.]')[0], '<i>.</i></span>',
            '<sup class="a-price-fraction">', split(money, '[.]')[1], '</sup>')
        WHEN 3 THEN concat('<td id="priceblock_ourprice">', money, '</td>')
        WHEN 4 THEN concat('<script>var d = {"price": "$', replace(substr(money, 2), ',', ''), '", "x": 1};</script>')
        ELSE '' END""",
    # rating and reviews
    """CASE p_partkey % 4
        WHEN 0 THEN '<i class="a-size-base a-color-base a-star-4-5"></i>'
        WHEN 1 THEN concat('<i class="a-icon-star"><span class="a-icon-alt">', p_size % 5, '.', p_size % 10,
            ' out of 5 stars</span></i>')
        WHEN 2 THEN '<i class="a-size-base a-color-base">x</i><span class="a-icon-alt">4 out of 5 stars</span>'
        ELSE '' END""",
    """CASE p_partkey % 5
        WHEN 4 THEN ''
        WHEN 3 THEN concat('<div>', format_number(p_partkey * 37 + 1, 0), ' global ratings</div>')
        ELSE concat('<p><span id="acrCustomerReviewText">', format_number(p_partkey * 3701 + 1, 0), ' ratings</span>')
        END""",
    # image
    """if(p_partkey % 2 = 0, concat('<img id="landingImage" src="https://i/', p_partkey, '?fmt=webp">'),
        concat('<img id="main-image" hidden src="https://i/no"><img class="x a-dynamic-image" src="https://j/', p_partkey,
            '?a=1&amp;b=2">'))""",
    # description
    """CASE p_partkey % 3
        WHEN 0 THEN concat('<div id="feature-bullets"><ul><li>A ', p_name, '!!<li>See  more</ul></div>',
            '<div id="productDescription"><p>A ', p_name, '! <script>f();</script></div>')
        WHEN 1 THEN concat('<div id="productDescription"><p>Fine ', p_name, '. Size: S, M,XL. Color: Red, ', p_name,
            '.</div><div id="detailBullets_feature_div">Return it; or not</div>')
        ELSE concat('<div id="productDetails_techSpec_section_1"><table><tr><td>Type<td>', p_type,
            '</table>Available sizes: ', p_size, ', ', p_size + 2, '</div>') END""",
    # availability
    """CASE p_partkey % 8
        WHEN 0 THEN '<input id="add-to-cart-button" type="submit">'
        WHEN 1 THEN '<div class="out-of-stock">none left</div>'
        WHEN 2 THEN '<button id="preOrderButton">Order</button>'
        WHEN 3 THEN '<div id="availability"><span> Only 3 left </span></div>'
        WHEN 4 THEN '<b class="a-color-price"> Soon </b>'
        WHEN 5 THEN '<button id="my-addToCart-1">x</button>'
        WHEN 6 THEN '<input id="add-to-cart-button" disabled>'
        ELSE '' END""",
]


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, html``: one page per part, covering every branch of every field."""
    part = dealt_table(spark, sf_dir, "part", "p_partkey").selectExpr(
        "*",
        "if(p_partkey % 4 = 3, concat('A ', p_name), p_name) AS title",
        f"concat('$', format_number({_TEN}, 2)) AS money",
        f"concat('$', format_number({_TEN} + 100, 2)) AS strike",
    )
    html = ", '\\n', ".join(f"({piece})" for piece in _PIECES)
    page = f"concat('<html><head><title>Shop &amp; more</title></head><body>', {html}, '</body></html>')"
    return with_computed(part, "html", F.expr(page)).selectExpr(
        "p_partkey AS page_id", "concat('https://www.amazon.com/dp/B', lpad(p_partkey, 9, '0')) AS url", "html"
    )


_NOW = "CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE {} END".format(
    "CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 10 AS DECIMAL(12,2))"
)
_OLD = "CASE WHEN p_partkey % 6 = 1 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 10 + 100 AS DECIMAL(12,2)) END"
_TITLE = "CASE WHEN p_partkey % 4 = 3 THEN 'A ' || p_name ELSE p_name END"
_BRAND = """CASE p_partkey % 4 WHEN 0 THEN p_brand
    WHEN 1 THEN 'O''Neil ' || upper(p_type[1]) || lower(p_type[2:]) || ' Co'
    WHEN 2 THEN split_part(p_name, ' ', 1) END"""
_RATING = """CASE p_partkey % 4 WHEN 0 THEN 4.5::DOUBLE
    WHEN 1 THEN CAST((p_size % 5) || '.' || (p_size % 10) AS DOUBLE) WHEN 2 THEN 4.0::DOUBLE END"""
_REVIEWS = """CASE p_partkey % 5 WHEN 4 THEN NULL WHEN 3 THEN p_partkey * 37 + 1 ELSE p_partkey * 3701 + 1 END"""
_IMAGE = """CASE WHEN p_partkey % 2 = 0 THEN 'https://i/' || p_partkey || '?fmt=webp'
    ELSE 'https://j/' || p_partkey || '?a=1&b=2' END"""
_DESCRIPTION = """CASE p_partkey % 3
    WHEN 0 THEN 'Product Description:' || chr(10) || 'A ' || p_name || '!'
    WHEN 1 THEN 'Product Description:' || chr(10) || 'Fine ' || p_name || '.' || chr(10) || 'Size: S, M,XL.' || chr(10)
      || 'Color: Red, ' || p_name || '.'
    ELSE 'Technical Details:' || chr(10) || 'Type ' || p_type || ' Available sizes: ' || p_size || ', ' || (p_size + 2) END"""
_STATUS = """CASE WHEN p_partkey % 8 = 0 OR p_partkey % 6 IN (0, 1, 3) THEN 'In Stock'
    WHEN p_partkey % 8 = 1 THEN 'Currently unavailable' WHEN p_partkey % 8 = 2 THEN 'Available for Pre-order'
    WHEN p_partkey % 8 = 3 THEN 'Only 3 left' WHEN p_partkey % 6 IN (2, 4) THEN 'In Stock'
    WHEN p_partkey % 8 = 4 THEN 'Soon' WHEN p_partkey % 8 IN (5, 6) THEN 'In Stock' ELSE 'Status Unknown' END"""
_AMOUNT = "CASE p_partkey % 6 WHEN 0 THEN '12.50' WHEN 1 THEN p_size || '.00' END"
_PERCENT = "CASE WHEN p_partkey % 6 = 1 THEN CAST(p_size AS DOUBLE) END"


@query(f"""
SELECT p_partkey AS page_id, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin, {_TITLE} AS title,
       CAST({_NOW} AS VARCHAR) AS current_price, CAST({_OLD} AS VARCHAR) AS original_price, {_AMOUNT} AS amount,
       {_PERCENT} AS percentage, {_RATING} AS rating, CAST({_REVIEWS} AS BIGINT) AS review_count,
       {_DESCRIPTION} AS description, {_IMAGE} AS image_url, {_BRAND} AS brand, {_STATUS} AS availability
FROM part
""")
def product_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_products(product_pages(spark, sf_dir)).select(
        "page_id", "asin", "title",
        money_text(F.col("price.current_price")).alias("current_price"),
        money_text(F.col("price.original_price")).alias("original_price"),
        money_text(F.col("price.savings.amount")).alias("amount"),
        F.col("price.savings.percentage").cast("double").alias("percentage"),
        "rating", "review_count", "description", "image_url", "brand", "availability",
    )


def _field_query(name: str, field: str, sql: str, *columns) -> None:
    """A query that asks for one field only; the selectors of the others are not tried."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = [F.expr(text).alias(alias) for alias, text in columns]
        return extract_products(product_pages(spark, sf_dir), fields=[field]).select("page_id", *wanted)

    run.__name__ = name
    query(f"SELECT p_partkey AS page_id, {sql} FROM part")(run)


_field_query("product_titles", "title", f"{_TITLE} AS title", ("title", "title"))
_field_query(
    "product_prices",
    "price",
    f"CAST({_NOW} AS VARCHAR) AS now, CAST({_OLD} AS VARCHAR) AS before",
    ("now", "cast(price.current_price AS string)"),
    ("before", "cast(price.original_price AS string)"),
)
_field_query(
    "savings_parse",
    "price",
    f"{_AMOUNT} AS amount, {_PERCENT} AS percentage",
    ("amount", "cast(price.savings.amount AS string)"),
    ("percentage", "cast(price.savings.percentage AS double)"),
)
_field_query("rating_parse", "rating", f"{_RATING} AS rating", ("rating", "rating"))
_field_query("review_count", "review_count", f"CAST({_REVIEWS} AS BIGINT) AS review_count", ("review_count", "review_count"))
_field_query("description_sections", "description", f"{_DESCRIPTION} AS description", ("description", "description"))
_field_query("main_image", "image_url", f"{_IMAGE} AS image_url", ("image_url", "image_url"))
_field_query("brand_chain", "brand", f"{_BRAND} AS brand", ("brand", "brand"))
_field_query("availability", "availability", f"{_STATUS} AS availability", ("availability", "availability"))


@query(f"""
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 6 IN (0, 1, 3) THEN CAST({_NOW} AS VARCHAR) END AS price FROM part
""")
def alternative_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alternative_prices(product_pages(spark, sf_dir)).select("page_id", money_text(F.col("price")).alias("price"))


@query("""
SELECT p_partkey AS page_id, kind AS content_type
FROM (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [NULL, 'Key Features']
          WHEN 1 THEN [NULL, 'Product Details'] ELSE ['Product Details'] END) AS kind FROM part)
""")
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = [("CSS_SELECTOR", ", ".join(f"#{key}" for key, _ in v.DESCRIPTION_SECTIONS))]
    return content_types(product_pages(spark, sf_dir), sections).select("page_id", "content_type")


@query("""
SELECT p_partkey AS page_id FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 6 <> 5
""")
def readable_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throttled pages, and pages that lost their title and have no price, give no record."""
    pages = product_pages(spark, sf_dir)
    throttled = F.lit("Request was throttled. Please wait a moment and refresh the page in your browser")
    html = F.regexp_replace("html", 'id="productTitle"|nav-search-label', 'class="none"')
    changed = F.when(F.col("page_id") % 10 == 0, F.concat("html", throttled)).otherwise(html)
    return extract_products(pages.withColumn("html", changed), fields=[]).select("page_id")


@query("""
SELECT p_partkey AS page_id, 'b' || p_partkey || 'deep' || p_partkey AS second, CAST(0 AS BIGINT) AS inner_texts,
       CAST(1 + p_partkey % 3 AS BIGINT) AS own_texts, p_name AS keyed
FROM part
""")
def selector_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position after another test, first runs of text without what lies inside, attribute names in any case."""
    pages = dealt_table(spark, sf_dir, "part", "p_partkey").selectExpr(
        "p_partkey AS page_id",
        """concat('<ul><li CLASS="k">a', p_partkey, '</li><li>skip</li><li class="k">b', p_partkey, '<b>deep', p_partkey,
            '</b></li></ul>', repeat('<i>own<u>deep</u></i>', 1 + p_partkey % 3), '<p Data-Key="', p_name, '">t</p>') AS html""",
    )
    second, inner, own = (
        ("XPATH", path)
        for path in ("//li[@class='k'][2]", "//i[contains(text(),'deep')]", "//i[contains(text(),'own')]")
    )
    keyed = ("CSS_SELECTOR", "[DATA-KEY]")
    chosen = SelectorSet([second, inner, own, keyed])
    found = shred(pages, chosen.probes).withColumn("hits", chosen.hits())
    return found.select(
        "page_id",
        chosen.first_text([second]).alias("second"),
        F.size(chosen.indexes(inner)).cast("long").alias("inner_texts"),
        F.size(chosen.indexes(own)).cast("long").alias("own_texts"),
        chosen.first_attribute([keyed], "data-key").alias("keyed"),
    )
