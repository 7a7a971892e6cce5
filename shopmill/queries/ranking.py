"""Search and best-seller pages written from the part table, and ranked links of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmill.operators.rank import (
    bestseller_links,
    check_ranks,
    count_links,
    first_per_asin,
    limit_ranked,
    result_counts,
    search_links,
    use_fallback,
)
from shopmill.queries.registry import dealt_table, query, table

# Each page holds twelve items. Some are sponsored, some repeat a product, some have a badge (one without a number),
# and in some the first link is no product link that can be read.
_ITEM = """concat('<div data-component-type="s-search-result">',
    if((p_partkey + i) % 5 = 0, '<div data-component-type="sp-sponsored-result"></div>', ''),
    CASE (p_partkey + i) % 4 WHEN 0 THEN concat('<span class="zg-badge-text">#', (i * 5) % 13 + 1, '</span>')
        WHEN 1 THEN '<span class="x zg-badge-wide">Best</span>' ELSE '' END,
    '<a href="/help">?</a><a class="a-link-normal" href="/p/dp/',
    if((p_partkey + i) % 6 = 0, 'b', 'B'), lpad(p_partkey * 3 + i % 9, 9, '0'), '/ref=', i, '">t</a>',
    '<a href="/dp/B999999999">other</a></div>')"""


def _pages(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    return dealt_table(spark, sf_dir, "part", "p_partkey").selectExpr(
        "p_partkey AS page_id",
        "concat('https://www.amazon.com/s?k=', p_partkey) AS url",
        f"concat('<html><body><ul>', {body}, '</ul></body></html>') AS html",
    )


def _items(item: str, n: int = 12) -> str:
    return f"array_join(transform(sequence(0, {n - 1}), i -> {item}), '\\n')"


_RANKED_SQL = """
  SELECT p_partkey AS page_id, i + 1 AS pos, 'B' || lpad(CAST(p_partkey * 3 + i % 9 AS VARCHAR), 9, '0') AS asin,
         CASE WHEN (p_partkey + i) % 4 = 0 THEN (i * 5) % 13 + 1 ELSE i + 1 END AS rank
  FROM part, (SELECT unnest(range(12)) AS i)
  WHERE (p_partkey + i) % 5 <> 0 AND (p_partkey + i) % 6 <> 0"""


@query(f"""
SELECT page_id, CAST(rank AS INTEGER) AS rank, CAST(pos AS INTEGER) AS pos, asin,
       'https://www.amazon.com/dp/' || asin AS url
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, asin ORDER BY rank, pos) AS copy
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, pos) AS place FROM ({_RANKED_SQL}))
      WHERE place <= 6)
WHERE copy = 1
""")
def search_rank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_links(_pages(spark, sf_dir, _items(_ITEM)), 6, fallback=False).drop("source")


# The layouts of the fallbacks, by page number; links repeat a product.
_FALLBACK_ITEM = """concat(CASE p_partkey % 5
        WHEN 0 THEN '<li data-component-type="s-search-result"><a ' WHEN 1 THEN '<li class="s-result-item" data-asin="x"><a class="a-link-normal" '
        WHEN 2 THEN '<li class="sg-col-inner"><a class="a-text-normal" '
        WHEN 3 THEN '<li class="s-include-content-margin"><a class="b a-link-normal" '
        ELSE '<li class="s-result-item"><a ' END,
    'href="/dp/B', lpad(p_partkey + i % 7, 9, '0'), '">t</a><a href="/dp/B000000000">x</a></li>')"""


@query("""
SELECT p_partkey AS page_id, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 ELSE p_partkey % 5 + 1 END AS INTEGER) AS source,
       CAST(i + 1 AS INTEGER) AS rank, 'B' || lpad(CAST(p_partkey + i AS VARCHAR), 9, '0') AS asin
FROM part, (SELECT unnest(range(5)) AS i) WHERE p_partkey % 5 < 4
UNION ALL
SELECT p_partkey, 5, CAST(CASE WHEN p_partkey = 0 OR i = 0 THEN i + 1 ELSE i + 2 END AS INTEGER),
       'B' || lpad(CAST(p_partkey + i AS VARCHAR), 9, '0')
FROM part, (SELECT unnest(range(4)) AS i) WHERE p_partkey % 5 = 4
UNION ALL
SELECT p_partkey, 5, 2, 'B000000000' FROM part WHERE p_partkey % 5 = 4
""")
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = search_links(_pages(spark, sf_dir, _items(_FALLBACK_ITEM)), 5)
    return links.select("page_id", "source", "rank", "asin")


_CARD = """concat('<div class="', if(i % 2 = 0, 'zg-item-immersion', 'x zg-grid-item'), '"><p><span class="zg-bdg-text">#',
    (i * 5 + p_partkey) % 12 + 1, '</span></p><div><a href="https://x/dp/B', lpad(p_partkey + i % 8, 9, '0'),
    '">t</a></div></div>')"""


@query("""
SELECT page_id, CAST(rank AS INTEGER) AS rank, CAST(pos AS INTEGER) AS pos, asin
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, pos) AS place
      FROM (SELECT p_partkey AS page_id, (i * 5 + p_partkey) % 12 + 1 AS rank, i + 1 AS pos,
                   'B' || lpad(CAST(p_partkey + i % 8 AS VARCHAR), 9, '0') AS asin
            FROM part, (SELECT unnest(range(12)) AS i)))
WHERE place <= 10
""")
def bestseller_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = bestseller_links(_pages(spark, sf_dir, _items(_CARD)), 10, fallback=False)
    return links.select("page_id", "rank", "pos", "asin")


# The badge lies i levels below the element that also holds the link, which is within reach for i < 5.
_DEEP_CARD = """concat('<section><a href="/dp/B', lpad(p_partkey + i, 9, '0'), '">t</a>', repeat('<div>', i),
    '<span class="zg-ranking">', i + 1, '.</span>', repeat('</div>', i), '</section>')"""


@query("""
SELECT p_partkey AS page_id, 3 AS source, CAST(i + 1 AS INTEGER) AS rank,
       'B' || lpad(CAST(p_partkey + i AS VARCHAR), 9, '0') AS asin
FROM part, (SELECT unnest(range(5)) AS i)
""")
def bestseller_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = bestseller_links(_pages(spark, sf_dir, _items(_DEEP_CARD, 8)), 10)
    return links.select("page_id", "source", "rank", "asin")


@query("""
SELECT p_partkey AS page_id, CAST(12 - p_partkey % 3 AS INTEGER) AS items, p_partkey % 3 < 2 AS enough FROM part
""")
def enough_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = """if(i < p_partkey % 3, '<div data-component-type="sp-sponsored-result"></div>',
        '<div data-component-type="s-search-result"></div>')"""
    return result_counts(_pages(spark, sf_dir, _items(item)), 11)


# Line items as ranked links: an order is a page, a line's quantity its rank, a part a product.
def _links(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"),
        F.col("l_quantity").cast("int").alias("rank"),
        F.expr("cast(l_linenumber AS bigint) * 1000000000 + l_partkey * 1000 + l_suppkey").alias("pos"),
        F.expr("concat('B', lpad(l_partkey % 40, 9, '0'))").alias("asin"),
        *map(F.expr, extra),
    )


_LINKS_SQL = """(SELECT l_orderkey AS page_id, CAST(l_quantity AS INTEGER) AS rank,
    CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS pos,
    'B' || lpad(CAST(l_partkey % 40 AS VARCHAR), 9, '0') AS asin, l_returnflag = 'R' AS returned
    FROM lineitem)"""


@query(f"""
SELECT page_id, rank, pos, asin, CAST(place AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, pos) AS place FROM {_LINKS_SQL}) WHERE place <= 3
""")
def ranked_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_ranked(_links(spark, sf_dir), 3)


@query(f"""
SELECT page_id, asin, rank, pos
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, asin ORDER BY rank, pos) AS copy
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, pos) AS place FROM {_LINKS_SQL})
      WHERE place <= 5)
WHERE copy = 1
""")
def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_asin(limit_ranked(_links(spark, sf_dir), 5))


@query(f"""
WITH links AS {_LINKS_SQL}
SELECT page_id, rank, pos, asin FROM links WHERE returned
UNION ALL
SELECT page_id, rank, pos, asin FROM links
WHERE NOT returned AND page_id NOT IN (SELECT page_id FROM links WHERE returned)
""")
def fallback_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as primary links, all others as fallback links."""
    links = _links(spark, sf_dir, "l_returnflag = 'R' AS returned")
    return use_fallback(links.filter("returned"), links.filter("NOT returned")).drop("returned")


@query("""
WITH links AS (SELECT l_orderkey AS page_id, l_linenumber AS rank,
    CAST(l_shipdate AS DATE) - DATE '1990-01-01' AS pos, l_partkey, l_suppkey FROM lineitem)
SELECT page_id, CAST(count(*) AS BIGINT) AS links, count(DISTINCT rank) = count(*) AND min(rank) = 1
         AND max(rank) = count(*) AND bool_and(coalesce(ordered, TRUE)) AS in_order
FROM (SELECT a.page_id, a.rank, (SELECT bool_and(a.pos < b.pos) FROM links b
        WHERE b.page_id = a.page_id AND b.rank = a.rank + 1) AS ordered FROM links a)
GROUP BY page_id
""")
def rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"),
        F.col("l_linenumber").alias("rank"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("pos"),
    )
    return check_ranks(lines)


@query(f"SELECT page_id, count(*) AS links, count(DISTINCT asin) AS products FROM {_LINKS_SQL} GROUP BY page_id")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_links(_links(spark, sf_dir))
