"""Queries over URLs, names and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmill.functions import prices, text, urls, variants
from shopmill.queries.registry import query, table
from shopmill.sources.tables import search_terms


@query("""
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS term_pos, term,
       'https://www.amazon.com/s?k=' || replace(url_encode(term), '%20', '+')
         || '&s=exact-aware-popularity-rank&language=en_US&currency=USD' AS search_url
FROM (SELECT p_partkey, i, trim(parts[i]) AS term
      FROM (SELECT p_partkey, parts, unnest(range(1, len(parts) + 1)) AS i
            FROM (SELECT p_partkey, string_split(p_name || ', ' || p_brand || ',, a+b & c~*é,' || p_type, ',') AS parts
                  FROM part)))
WHERE term <> ''
""")
def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat(p_name, ', ', p_brand, ',, a+b & c~*é,', p_type) AS line"
    )
    return search_terms(lines).withColumn("search_url", urls.search_url(F.col("term")))


@query("""
SELECT p_partkey,
       CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN 'a b ' || p_partkey
         WHEN 2 THEN 'Search_Results' ELSE '100% ' || p_type || ' é' END AS category
FROM part
""")
def category_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("""CASE p_partkey % 4
        WHEN 0 THEN concat('https://x/s?k=', url_encode(concat(p_name, ' ', p_brand)), '&s=rank')
        WHEN 1 THEN concat('https://x/s?k=a%2Bb+', p_partkey, '&k=second')
        WHEN 2 THEN 'https://x/s?q=none'
        ELSE concat('https://x/s?k=100%+', p_type, '%20%C3%A9') END""")
    return table(spark, sf_dir, "part").select("p_partkey", urls.category_from_search_url(url).alias("category"))


@query("""
SELECT p_partkey,
       CASE p_partkey % 4 WHEN 0 THEN p_type || ' & Co-' || p_size WHEN 1 THEN 'a+b' WHEN 2 THEN '' ELSE NULL END
         AS category
FROM part
""")
def category_from_bestseller_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("""CASE p_partkey % 4
        WHEN 0 THEN concat('https://x/Best-Sellers-', p_type, '%20%26%20Co-', p_size, '/zgbs/1/zgbs')
        WHEN 1 THEN 'https://x/Best-Sellers-a+b/zgbs'
        WHEN 2 THEN 'https://x/Best-Sellers-/zgbs'
        ELSE 'https://x/Best-Sellers/zgbs/' END""")
    return table(spark, sf_dir, "part").select("p_partkey", urls.category_from_bestseller_url(url).alias("category"))


@query("""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'B' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS asin,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL
         ELSE 'https://www.amazon.com/dp/B' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS product_url
FROM lineitem
""")
def asin_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.expr("""named_struct('rank', l_linenumber, 'url', concat('https://www.amazon.com/x/dp/',
        if(l_linenumber % 3 = 0, 'b', 'B'), lpad(l_partkey, 9, '0'), '/ref=', l_suppkey))""").alias("link")
    links = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", link)
    asin = urls.extract_asin(urls.unwrap_url(F.col("link"), is_struct=True))
    return links.select("l_orderkey", "l_linenumber", asin.alias("asin")).withColumn(
        "product_url", urls.product_url(F.col("asin"))
    )


@query("""
SELECT p_partkey,
       'https://www.amazon.com' || CASE WHEN p_partkey % 5 = 3 THEN '.au' ELSE '' END
         || CASE WHEN p_partkey % 7 = 0 THEN '/gp/switch-language/' ELSE '/dp/' END || p_partkey AS url,
       p_partkey % 7 = 0 AS redirected
FROM part WHERE p_partkey % 5 < 4
UNION ALL
SELECT p_partkey, 'https://other.example' || CASE WHEN p_partkey % 7 = 0 THEN '/gp/switch-language/' ELSE '/dp/' END
         || p_partkey, TRUE
FROM part WHERE p_partkey % 5 = 4
""")
def host_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("""concat('https://', element_at(array('www.amazon.cn', 'www.amazon.co.jp', 'www.amazon.co.uk',
        'www.amazon.com.au', 'other.example'), cast(p_partkey % 5 AS int) + 1),
        if(p_partkey % 7 = 0, '/gp/switch-language/', '/dp/'), p_partkey)""")
    return table(spark, sf_dir, "part").select("p_partkey", urls.rewrite_host(url).alias("url")).withColumn(
        "redirected", urls.is_redirected(F.col("url"))
    )


@query(r"""
SELECT doc_id, regexp_replace(text || '<>:"/\|?*' || source, '[<>:"/\\|?*]', '_', 'g') AS safe_name
FROM documents
""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("text"), F.lit('<>:"/\\|?*'), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", urls.safe_file_name(name).alias("safe_name"))


@query("""
SELECT p_partkey, CASE p_partkey % 5
         WHEN 0 THEN CAST(CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 10 AS DECIMAL(12,2)) AS VARCHAR)
         WHEN 1 THEN CAST(p_size AS VARCHAR) || '.00'
         WHEN 2 THEN CAST(p_size AS VARCHAR) || '.50'
         WHEN 3 THEN NULL ELSE '2.68' END AS price,
       CASE p_partkey % 5 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size + 0.5 WHEN 4 THEN 2.675
         WHEN 0 THEN 9.0 ELSE NULL END AS percentage
FROM part
""")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("""CASE p_partkey % 5
        WHEN 0 THEN concat('$', format_number(cast(p_retailprice AS decimal(12,2)) * 10, 2))
        WHEN 1 THEN concat(' $ ', p_size, '. each') WHEN 2 THEN concat('\\n', p_size, '\\t.5 %')
        WHEN 3 THEN 'ask us' ELSE 'USD2.675' END""").alias("raw")
    both = table(spark, sf_dir, "part").select("p_partkey", raw)
    percentage = F.regexp_extract("raw", r"(\d+(?:\s*\.\d+)?)", 1)
    return both.select(
        "p_partkey",
        prices.money_text(prices.parse_price(F.col("raw"))).alias("price"),
        F.regexp_replace(percentage, r"\s", "").try_cast("double").alias("percentage"),
    )


# The cleaning chain in the dialect of the checking engine: no back-references, so one rule per character.
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}"
_BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"


def _sql_chain(column: str, *rules: tuple[str, str, str]) -> str:
    for pattern, replacement, flags in rules:
        pattern = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{pattern}', {replacement}, '{flags}')"
    return column


_CLEAN_SQL = _sql_chain(
    f"trim(text, {_BLANKS})",
    (f"[{_SPACE}]+", "' '", "g"),
    (f"[^{_WORD}{_SPACE}" + r""".,;:!?()'"\-–—/]""", "''", "g"),
    (r"\.\.+", "'.'", "g"), (",,+", "','", "g"), ("!!+", "'!'", "g"), (r"\?\?+", "'?'", "g"),
    (rf"([.!?])[{_SPACE}]*([{_WORD}])", r"'\1' || chr(10) || '\2'", "g"),
    *((phrase, "''", "gi") for phrase in text.BOILERPLATE),
)


@query(f"SELECT doc_id, nullif(trim({_CLEAN_SQL}, {_BLANKS}), '') AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


_CODE_SQL = _sql_chain(
    "text",
    (r"<script[\s\S]*?</script>", "''", "gi"), (r"<style[\s\S]*?</style>", "''", "gi"),
    (rf"function[{_SPACE}]*[{_WORD}]*[{_SPACE}]*\{{[\s\S]*?\}}", "''", "gi"),
    (rf"var[{_SPACE}]+[{_WORD}]+[{_SPACE}]*=", "''", "gi"), (rf"\.[{_WORD}\-]+[{_SPACE}]*\{{[^}}]*\}}", "''", "gi"),
    (r"/\*[\s\S]*?\*/", "''", "gi"), ("//.*", "''", "gi"), (r"console\.log\(.*?\)", "''", "gi"),
    (r"document\..*?;", "''", "gi"), (r"window\..*?;", "''", "gi"), (r"\$\(.*?\)", "''", "gi"),
)
_MARKS_SQL = " OR ".join(f"contains(t, '{mark}')" for mark in text.CODE_MARKS)


@query(f"""
SELECT doc_id, CASE WHEN {_MARKS_SQL} THEN NULL ELSE nullif(t, '') END AS prose
FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_CODE_SQL}, chr(10)),
        lambda l: trim(l, {_BLANKS})), lambda l: l <> ''), chr(10)) AS t
      FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' // note' WHEN 1 THEN text || '/* x */ VAR y = 1'
              WHEN 2 THEN '<script>f()</script> ' || chr(10) || text ELSE text END AS text FROM documents))
""")
def filter_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat(text, ' // note')
        WHEN 1 THEN concat(text, '/* x */ VAR y = 1') WHEN 2 THEN concat('<script>f()</script> \\n', text)
        ELSE text END""")
    return table(spark, sf_dir, "documents").select("doc_id", text.filter_code(mixed).alias("prose"))


@query(rf"""
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE trim(left(text, cut), {_BLANKS}) END AS kept
FROM (SELECT doc_id, text, coalesce(
        CASE WHEN p > 0 AND 400 - p - 1 > 0 THEN 400 - p + 1 END, CASE WHEN d > 0 AND 400 - d - 1 > 0 THEN 400 - d + 1 END,
        CASE WHEN e > 0 AND 400 - e - 1 > 0 THEN 400 - e + 1 END, CASE WHEN q > 0 AND 400 - q - 1 > 0 THEN 400 - q + 1 END,
        400) AS cut
      FROM (SELECT doc_id, text, strpos(r, chr(10) || chr(10)) AS p, strpos(r, ' .') AS d, strpos(r, ' !') AS e,
              strpos(r, ' ?') AS q
            FROM (SELECT doc_id, text, array_to_string(list_reverse(string_split(substring(text, 1, 400), '')), '') AS r
                  FROM documents)))
""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.truncate_text(F.col("text"), 400).alias("kept"))


@query(rf"""
SELECT doc_id, CASE WHEN length(plain) <= 100 THEN head
         WHEN strpos(reversed, ' ') > 0 AND strpos(reversed, ' ') < length(head)
         THEN substring(head, 1, length(head) - strpos(reversed, ' ')) || '...' ELSE head || '...' END AS short
FROM (SELECT doc_id, plain, head, array_to_string(list_reverse(string_split(head, '')), '') AS reversed
      FROM (SELECT doc_id, plain, trim(substring(plain, 1, 100), {_BLANKS}) AS head
            FROM (SELECT doc_id, regexp_replace('<b>New</b> ' || text, '<[^>]+>', '', 'g') AS plain FROM documents)))
""")
def short_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<b>New</b> "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.short_description(marked).alias("short"))


@query("""
SELECT p_partkey,
       CASE p_partkey % 5 WHEN 0 THEN 'L,M,xl' WHEN 1 THEN p_size || ',' || p_size || '.5,s'
         WHEN 2 THEN 'Large,Small,s' WHEN 3 THEN 's,small' ELSE '' END AS sizes,
       CASE p_partkey % 5 WHEN 0 THEN 'Navy blue,' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'Available color Blue,Blue'
         WHEN 3 THEN 'ful ' || p_name ELSE 'As shown in the figure' END AS colors
FROM part
""")
def sizes_and_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("""CASE p_partkey % 5
        WHEN 0 THEN concat('Size: M, xl, L! Size L. Colors: ', p_name, ', Navy blue.')
        WHEN 1 THEN concat('Available sizes: ', p_size, ', ', p_size, '.5 cm. Colour ', p_name)
        WHEN 2 THEN 'Sizes available: Small, Large. Color: Available color Blue.'
        WHEN 3 THEN concat('sizes: small. Colorful ', p_name, '.\\nColor 12.')
        ELSE concat('A ', p_name, ' of type ', p_type) END""").alias("said")
    found = table(spark, sf_dir, "part").select("p_partkey", said).select(
        "p_partkey", variants.sizes(F.col("said")).alias("s"), variants.colors(F.col("said")).alias("c")
    )
    shown = F.when(F.size("c") > 0, F.array_join("c", ",")).otherwise(F.lit(variants.DEFAULT_COLOR))
    return found.select("p_partkey", F.array_join("s", ",").alias("sizes"), shown.alias("colors"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(
         regexp_extract_all(text || chr(10) || 'Size: S, M', 'Size:?\\s*((?:X?S|X?M|X?L|XXL|XXXL|2XL|3XL|4XL|5XL)(?:\\s*,\\s*(?:X?S|X?M|X?L|XXL|XXXL|2XL|3XL|4XL|5XL))*)', 1, 'i'),
         lambda m: string_split(m, ','))), lambda x: trim(x)))), ',') AS sizes
FROM documents
""".replace("\\\\", "\\"))
def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("text"), F.lit("\nSize: S, M"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(variants.sizes(said), ",").alias("sizes"))
