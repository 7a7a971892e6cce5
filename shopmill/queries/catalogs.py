"""Catalog rows built from product records that stand for parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmill.functions.urls import safe_file_name
from shopmill.operators.catalog import stage_from_csv_columns, to_catalog, to_stage
from shopmill.operators.report import file_report
from shopmill.plans.harvest import catalog_from_csv, harvest, written
from shopmill.queries.product_pages import product_pages
from shopmill.queries.registry import dealt_table, query, table, work_folder
from shopmill.schemas import CATALOG_COLUMNS, PRICE, STAGE_COLUMNS
from shopmill.sources.csv_files import read_stage_csv, write_catalog, write_stage, written_files
from shopmill.sources.tables import read_pages

_PRICE = "cast(p_retailprice AS decimal(12,2))"


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product records of the parts: with and without sale, sizes, colours, category, image and number."""
    return dealt_table(spark, sf_dir, "part", "p_partkey").selectExpr(
        "p_partkey AS product_seq",
        "if(p_partkey % 11 = 0, NULL, concat('B', lpad(p_partkey, 9, '0'))) AS asin",
        "p_name AS title",
        """CASE p_partkey % 4
            WHEN 0 THEN concat('Key Features:\\nMade by ', p_brand, '. Size: S, M, L.\\nColor: Red, ', p_name, '.')
            WHEN 1 THEN concat('Available sizes: ', p_size, ', ', p_size + 1, ' cm "wide"')
            WHEN 2 THEN concat('A plain, ', p_name, '.\\nColour: ', p_name, '.')
            END AS description""",
        f"""named_struct('current_price', if(p_partkey % 5 = 4, NULL, {_PRICE}),
            'original_price', if(p_partkey % 5 IN (1, 4), {_PRICE} + 100, if(p_partkey % 5 = 2, {_PRICE}, NULL)),
            'deal_price', NULL, 'price_range', named_struct('min', NULL, 'max', NULL),
            'savings', named_struct('amount', NULL, 'percentage', NULL),
            'prime_price', NULL, 'installment', NULL, 'coupon', NULL) AS price""",
        "if(p_partkey % 7 = 0, NULL, concat('https://i/', p_partkey, '?fmt=webp')) AS image_url",
        "if(p_partkey % 6 = 0, NULL, p_type) AS category",
    ).withColumn("price", F.col("price").cast(PRICE))


_STAGE_SQL = """
SELECT p_partkey AS product_seq, p_name AS title, description,
       coalesce(CASE WHEN length(description) > 100 THEN NULL ELSE description END, '') AS short_description,
       CAST(CASE WHEN p_partkey % 5 IN (1, 4) THEN price + 100 ELSE price END AS VARCHAR) AS regular_price,
       CASE WHEN p_partkey % 5 = 1 THEN CAST(price AS VARCHAR) END AS sale_price,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS category,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'https://i/' || p_partkey || '?fmt=jpg' END AS images,
       CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS sku,
       CASE p_partkey % 4 WHEN 0 THEN 'L,M,S'
         WHEN 1 THEN array_to_string(list_sort([CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR), 's']), ',')
         ELSE '' END AS sizes,
       CASE p_partkey % 4 WHEN 0 THEN 'Red,' || p_name WHEN 2 THEN p_name ELSE 'As shown in the figure' END AS colors
FROM (SELECT *, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS price,
        CASE p_partkey % 4
          WHEN 0 THEN 'Key Features:' || chr(10) || 'Made by ' || p_brand || '. Size: S, M, L.' || chr(10) || 'Color: Red, ' || p_name || '.'
          WHEN 1 THEN 'Available sizes: ' || p_size || ', ' || (p_size + 1) || ' cm "wide"'
          WHEN 2 THEN 'A plain, ' || p_name || '.' || chr(10) || 'Colour: ' || p_name || '.' END AS description
      FROM part)"""


@query(_STAGE_SQL)
def stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_stage(part_records(spark, sf_dir))


_BLOCKS_SQL = f"""
SELECT *, 10000 + coalesce(sum(n) OVER (ORDER BY product_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS start_id
FROM (SELECT *, CASE WHEN sizes = '' THEN 1
        ELSE 1 + len(string_split(sizes, ',')) * len(string_split(colors, ',')) END AS n FROM ({_STAGE_SQL}))"""

_NULL = "CAST(NULL AS VARCHAR)"
_BASE_SQL = {
    "ID": "CAST(start_id AS BIGINT)", "Type": "CASE WHEN n > 1 THEN 'variable' ELSE 'simple' END", "SKU": "sku",
    "Name": "title", "Published": "'1'", "Is featured?": "'0'", "Visibility in catalog": "'visible'",
    "Short description": "short_description", "Description": "description", "In stock?": "'1000'",
    "Sale price": "coalesce(sale_price, '')", "Regular price": "CASE WHEN n > 1 THEN '' ELSE regular_price END",
    "Categories": "coalesce(category, 'Uncategorized')", "Images": "images",
    "Attribute 1 name": "CASE WHEN n > 1 THEN 'Size' ELSE '' END", "Attribute 1 value(s)": "sizes",
    "Attribute 1 visible": "CASE WHEN n > 1 THEN '1' ELSE '' END",
    "Attribute 1 global": "CASE WHEN n > 1 THEN '1' ELSE '' END",
    "Attribute 2 name": "'Color'", "Attribute 2 value(s)": "colors", "Attribute 2 visible": "'1'",
    "Attribute 2 global": "'1'",
}
_VARIATION_SQL = {
    "ID": "CAST(start_id + k AS BIGINT)", "Type": "'variation'", "SKU": "''", "Name": "title || ' - ' || size",
    "Published": "'1'", "Visibility in catalog": "'visible'", "In stock?": "'1000'",
    "Sale price": "coalesce(sale_price, regular_price)", "Regular price": "regular_price",
    "Parent": "'id:' || CAST(start_id AS BIGINT)", "Attribute 1 name": "'Size'", "Attribute 1 value(s)": "size",
    "Attribute 1 visible": "'1'", "Attribute 1 global": "'1'", "Attribute 2 name": "'Color'",
    "Attribute 2 value(s)": "color", "Attribute 2 visible": "'1'", "Attribute 2 global": "'1'",
}


def _columns_sql(values: dict[str, str]) -> str:
    return ", ".join(f'{values.get(name, _NULL)} AS "{name}"' for name in CATALOG_COLUMNS)


_CATALOG_SQL = f"""
WITH blocks AS ({_BLOCKS_SQL}),
pairs AS (SELECT *, (i - 1) * len(cs) + j AS k, ss[i] AS size, cs[j] AS color
          FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS j
                FROM (SELECT *, string_split(sizes, ',') AS ss, string_split(colors, ',') AS cs,
                        unnest(range(1, len(string_split(sizes, ',')) + 1)) AS i
                      FROM blocks WHERE n > 1)))
SELECT {_columns_sql(_BASE_SQL)} FROM blocks UNION ALL SELECT {_columns_sql(_VARIATION_SQL)} FROM pairs"""


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of the parts. The staging rows are written once, as the whole job does; numbers and rows start there."""
    stage = written(to_stage(part_records(spark, sf_dir)), f"{work_folder(spark)}/stage")
    return to_catalog(stage)


@query(_CATALOG_SQL)
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_catalog(spark, sf_dir).select(*CATALOG_COLUMNS)


@query(f"""
SELECT "ID", "Name", "Parent", "Type" FROM ({_CATALOG_SQL}) WHERE "Type" = 'variation'
""")
def catalog_parent_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_catalog(spark, sf_dir)
    return rows.filter(F.col("Type") == "variation").select("ID", "Name", "Parent", "Type")


@query(f"""
SELECT "Type" AS kind, "Categories" AS category, count(*) AS rows FROM ({_CATALOG_SQL}) GROUP BY ALL
""")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_catalog(spark, sf_dir)
    return rows.groupBy(F.col("Type").alias("kind"), F.col("Categories").alias("category")).agg(
        F.count("*").alias("rows")
    )


_CSV_SQL = f"""
SELECT nullif(title, '') AS "Title", nullif(description, '') AS "Description", nullif(short_description, '') AS "Short description",
       nullif(regular_price, '') AS "Regular price", sale_price AS "Sale_Price", category AS "Category",
       nullif(images, '') AS "Images", nullif(sku, '') AS "SKU", nullif(sizes, '') AS "Sizes", colors AS "Color"
FROM ({_STAGE_SQL})"""


@query(_CSV_SQL)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging rows written by category and read back; line ends, quotes and leading zeros survive."""
    folder = work_folder(spark)
    write_stage(to_stage(part_records(spark, sf_dir)), folder, "20250101_000000")
    rows = stage_from_csv_columns(read_stage_csv(spark, f"{folder}/*/*.csv"), F.lit(0).cast("bigint"))
    return rows.drop("product_seq").toDF(*STAGE_COLUMNS)


# products come back by file, and files are named after categories
_FROM_FILES_SQL = _CATALOG_SQL.replace("ORDER BY product_seq", "ORDER BY coalesce(category, '') || '_products_', product_seq")
_CELLS_SQL = ", ".join(f"""nullif(CAST("{name}" AS VARCHAR), '') AS "{name}\"""" for name in CATALOG_COLUMNS)


@query(f"SELECT {_CELLS_SQL} FROM ({_FROM_FILES_SQL})")
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging files to catalog files, and what the catalog files hold: all cells, numbered in the order of the files."""
    base = work_folder(spark)
    write_stage(to_stage(part_records(spark, sf_dir)), f"{base}/stage", "20250101_000000")
    rows = catalog_from_csv(spark, f"{base}/stage/*/*.csv", base)
    write_catalog(rows, f"{base}/catalog")
    header = ", ".join(f"`{name}` string" for name in CATALOG_COLUMNS)
    return spark.read.schema(header).csv(f"{base}/catalog", header=True, multiLine=True, escape='"')


@query("""
SELECT category_name, 'u' || category_name AS url, product_count, coalesce(product_count, 0) AS rows,
       category_name <> 'none' AS has_files
FROM (SELECT p_type AS category_name, count(*) FILTER (p_partkey % 6 <> 0) AS product_count FROM part GROUP BY ALL
      HAVING product_count > 0 UNION ALL SELECT 'none', 0)
""")
def stage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of written staging files: what the files of each category hold; one category has none."""
    folder = work_folder(spark)
    records = part_records(spark, sf_dir)
    write_stage(to_stage(records), folder, "20250101_000000")
    counts = records.filter("category is not null").groupBy(F.col("category").alias("category_name"))
    counts = counts.agg(F.count("*").alias("product_count")).unionByName(
        spark.range(1).select(F.lit("none").alias("category_name"), F.lit(0).cast("long").alias("product_count"))
    )
    runs = counts.withColumns({"success": F.lit(True), "url": F.concat(F.lit("u"), "category_name")})
    files = file_report(runs, written_files(spark, folder))
    named = F.col("path").contains(safe_file_name(F.col("category_name"))) & (F.col("bytes") > 0)
    return files.groupBy("category_name", "url", "product_count").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.bool_and(named), F.lit(False)).alias("has_files")
    )


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search page per term, listing five products, some of which are not stored; some pages are throttled."""
    return dealt_table(spark, sf_dir, "part", "p_partkey").selectExpr(
        "p_partkey + 1000000000 AS page_id",
        """concat('https://www.amazon.cn/s?k=term+', p_partkey,
            '&s=exact-aware-popularity-rank&language=en_US&currency=USD') AS url""",
        """concat('<body>', array_join(transform(sequence(0, 4), i -> concat(
            '<div data-component-type="s-search-result"><a href="/dp/B', lpad(p_partkey + i, 9, '0'), '">t</a></div>')), ''),
            if(p_partkey % 5 = 3, 'Request was throttled. Please wait a moment and refresh the page', ''),
            '</body>') AS html""",
    )


def _harvest(spark: SparkSession, sf_dir: str, products: DataFrame | None = None):
    terms = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS term_pos", "concat('term ', p_partkey) AS term"
    )
    products = product_pages(spark, sf_dir) if products is None else products
    folder = work_folder(spark)
    products.unionByName(search_pages(spark, sf_dir)).write.parquet(f"{folder}/pages")
    return harvest(spark, terms, read_pages(spark, f"{folder}/pages"), folder)


_FOUND_SQL = """
  SELECT t.p_partkey AS term, i, p.p_partkey AS k, p.* FROM part t, (SELECT unnest(range(5)) AS i), part p
  WHERE t.p_partkey % 5 <> 3 AND p.p_partkey = t.p_partkey + i"""


@query(f"""
SELECT t.p_partkey AS term_pos, t.p_partkey % 5 <> 3 AS success,
       CASE WHEN t.p_partkey % 5 <> 3 THEN 'term ' || t.p_partkey END AS category_name,
       coalesce(c.n, 0) AS product_count
FROM part t LEFT JOIN (SELECT term, count(*) AS n FROM ({_FOUND_SQL}) GROUP BY term) c ON c.term = t.p_partkey
""")
def harvest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and pages through the whole job: the outcome per term."""
    return _harvest(spark, sf_dir).runs.select("term_pos", "success", "category_name", "product_count")


_HARVEST_ROWS_SQL = f"""
SELECT term, i, k, CASE k % 3 WHEN 1 THEN 'M,S,XL'
         WHEN 2 THEN array_to_string(list_sort([CAST(p_size AS VARCHAR), CAST(p_size + 2 AS VARCHAR), 's']), ',')
         ELSE '' END AS sizes, CAST(CASE k % 3 WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 1 END AS BIGINT) AS rows
FROM ({_FOUND_SQL})"""


@query(f"""
SELECT 'term ' || term AS category, 'B' || lpad(CAST(k AS VARCHAR), 9, '0') AS sku, sizes,
       CASE WHEN rows > 1 THEN 'variable' ELSE 'simple' END AS kind, rows,
       CAST(10000 + before AS BIGINT) AS first_id, CAST(10000 + before + rows - 1 AS BIGINT) AS last_id,
       CASE WHEN rows > 1 THEN 'id:' || CAST(10000 + before AS BIGINT) END AS parent
FROM (SELECT *, coalesce(sum(rows) OVER (ORDER BY term, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM ({_HARVEST_ROWS_SQL}))
""")
def harvest_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and pages through the whole job: each product with its catalog rows, their numbers and their parent."""
    rows = _harvest(spark, sf_dir).catalog
    return rows.groupBy("product_seq").agg(
        F.max("Categories").alias("category"),
        F.max("SKU").alias("sku"),
        F.max(F.when(F.col("k") == 0, F.col("Attribute 1 value(s)"))).alias("sizes"),
        F.max(F.when(F.col("k") == 0, F.col("Type"))).alias("kind"),
        F.count("*").alias("rows"),
        F.min("ID").alias("first_id"),
        F.max("ID").alias("last_id"),
        # of all variations: two parents would show
        F.array_join(F.sort_array(F.collect_set("Parent")), " ").alias("parents"),
    ).withColumn("parent", F.nullif("parents", F.lit(""))).drop("product_seq", "parents")


@query("""
SELECT page_id, url, reason FROM (
    SELECT p_partkey AS page_id,
           CASE p_partkey % 12 WHEN 3 THEN 'https://elsewhere.example/dp/B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')
             WHEN 4 THEN 'https://www.amazon.com/gp/switch-language?to=' || p_partkey
             ELSE 'https://www.amazon.com/dp/B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS url,
           CASE p_partkey % 12 WHEN 1 THEN 'empty page' WHEN 2 THEN 'throttled' WHEN 3 THEN 'redirected' WHEN 4 THEN 'redirected'
             -- a page that no list names is not read, so nothing is known to be missing in it
             WHEN 5 THEN CASE WHEN EXISTS (SELECT 1 FROM part t WHERE t.p_partkey % 5 <> 3
                 AND p.p_partkey BETWEEN t.p_partkey AND t.p_partkey + 4) THEN 'no title and no price' END END AS reason
    FROM part p
    UNION ALL
    SELECT p_partkey + 1000000000, 'https://www.amazon.com/s?k=term+' || p_partkey
             || '&s=exact-aware-popularity-rank&language=en_US&currency=USD',
           CASE WHEN p_partkey % 5 = 3 THEN 'throttled' END
    FROM part)
WHERE reason IS NOT NULL
""")
def pages_to_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twelfth product page is empty, throttled, redirected in two ways, or has nothing to read."""
    kind = F.col("page_id") % 12
    asin = F.concat(F.lit("B"), F.lpad(F.col("page_id").cast("string"), 9, "0"))
    html = (
        F.when(kind == 1, F.when(F.col("page_id") % 2 == 1, " \n").otherwise(F.lit(None).cast("string")))
        .when(kind == 2, F.concat("html", F.lit("Request was throttled. Please wait a moment and refresh the page")))
        .when(kind == 5, F.lit("<html><body><p>gone</p></body></html>"))
        .otherwise(F.col("html"))
    )
    url = (
        F.when(kind == 3, F.concat(F.lit("https://elsewhere.example/dp/"), asin))
        .when(kind == 4, F.concat(F.lit("https://www.amazon.com/gp/switch-language?to="), F.col("page_id").cast("string")))
        .otherwise(F.col("url"))
    )
    products = product_pages(spark, sf_dir).select("page_id", url.alias("url"), html.alias("html"))
    return _harvest(spark, sf_dir, products).refetch
