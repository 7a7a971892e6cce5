"""Product records to staging rows, and staging rows to the shop import layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmill.functions import variants
from shopmill.functions.columns import blank_to_null, strip
from shopmill.functions.prices import money_text
from shopmill.functions.text import short_description
from shopmill.operators.numbering import number_blocks
from shopmill.schemas import CATALOG_COLUMNS, STAGE_COLUMNS

# Constants of the import layout.
STOCK = "1000"
VISIBLE = "visible"
DEFAULT_CATEGORY = "Uncategorized"

#: Products of more catalog rows than this are cut into blocks of this many sizes by as many colours. Same rows either way.
SPLIT_FROM, BLOCK_SIDE = 100_000, 64


def plain_image_url(url: Column) -> Column:
    return F.coalesce(F.replace(url, F.lit("fmt=webp"), F.lit("fmt=jpg")), F.lit(""))


def to_stage(products: DataFrame, key: str = "product_seq", limit: int = 100) -> DataFrame:
    """Staging rows: the ten staging fields plus the unique ``key`` that gives the row order."""
    price = F.col("price")
    regular = F.coalesce(price["original_price"], price["current_price"])
    sized = products.withColumns(
        {"size_list": variants.sizes(F.col("description")), "color_list": variants.colors(F.col("description"))}
    )
    return sized.select(
        F.col(key).alias("product_seq"),
        "title",
        "description",
        short_description(F.col("description"), limit).alias("short_description"),
        money_text(regular).alias("regular_price"),
        money_text(F.when(price["current_price"] != regular, price["current_price"])).alias("sale_price"),
        "category",
        plain_image_url(F.col("image_url")).alias("images"),
        F.coalesce("asin", F.lit("")).alias("sku"),
        F.array_join("size_list", ",").alias("sizes"),
        F.when(F.size("color_list") > 0, F.array_join("color_list", ","))
        .otherwise(F.lit(variants.DEFAULT_COLOR))
        .alias("colors"),
    )


_STAGE_FIELDS = [
    "title", "description", "short_description", "regular_price", "sale_price",
    "category", "images", "sku", "sizes", "colors",
]


def stage_to_csv_columns(stage: DataFrame, *extra: str) -> DataFrame:
    """Staging rows under their file header."""
    return stage.select(*(F.col(f).alias(c) for f, c in zip(_STAGE_FIELDS, STAGE_COLUMNS)), *extra)


def stage_from_csv_columns(rows: DataFrame, key: Column) -> DataFrame:
    """Staging rows from a file; the text ``N/A`` and an empty cell mean a missing value."""
    fields = (
        F.when(F.col(f"`{c}`") != "N/A", blank_to_null(F.col(f"`{c}`"))).alias(f)
        for f, c in zip(_STAGE_FIELDS, STAGE_COLUMNS)
    )
    return rows.select(key.alias("product_seq"), *fields)


def _is_variable() -> Column:
    return F.coalesce(F.col("sizes"), F.lit("")) != ""


def _colors() -> Column:
    return F.coalesce(blank_to_null(F.col("colors")), F.lit(variants.DEFAULT_COLOR))


def catalog_size() -> Column:
    """Catalog rows that a staging row gives: itself and, with sizes, one per size and colour."""
    pairs = F.size(F.split("sizes", ",")).cast("bigint") * F.size(F.split(_colors(), ","))
    return F.when(_is_variable(), pairs + 1).otherwise(1)


def expand_rows(stage: DataFrame, split_from: int = SPLIT_FROM) -> DataFrame:
    """Base row of each product, followed (``k`` 1, 2, ...) by its variations, sizes outside, colours inside.

    Sizes and colours are exploded one after the other, so the pairs of a product never stand in memory together.
    The long texts travel inside the base entry only, so that exploding does not copy them per variation. A product
    of more than ``split_from`` rows is cut into blocks of sizes by colours that are dealt to all tasks before they
    become rows; its variations hold no ``sizes`` and ``colors``. ``variable`` tells products that have sizes.
    """
    stage = stage.withColumn("variable", _is_variable())
    large = catalog_size() > split_from
    return _expand_whole(stage.filter(~large)).unionByName(_expand_blocks(stage.filter(large)))


def _expand_whole(stage: DataFrame) -> DataFrame:
    def entry(place: Column, size: Column, description: Column, short: Column) -> Column:
        return F.struct(
            place.cast("bigint").alias("place"),
            size.cast("string").alias("size"),
            description.cast("string").alias("description"),
            short.cast("string").alias("short_description"),
        )

    none = F.lit(None)
    base = F.array(entry(F.lit(-1), none, F.col("description"), F.col("short_description")))
    sized = F.transform(F.split("sizes", ","), lambda size, i: entry(i, strip(size), none, none))
    slim = [name for name in stage.columns if name not in ("description", "short_description")]
    by_size = stage.select(
        *slim,
        F.split(_colors(), ",").alias("color_list"),
        F.explode(F.when(F.col("variable"), F.concat(base, sized)).otherwise(base)).alias("v"),
    )
    is_base = F.col("v.place") < 0
    colors = F.when(is_base, F.array(none.cast("string"))).otherwise(F.col("color_list"))
    by_color = by_size.select("*", F.posexplode(colors).alias("color_place", "color"))
    k = F.when(is_base, F.lit(0)).otherwise(F.col("v.place") * F.size("color_list") + F.col("color_place") + 1)
    return by_color.select(
        *slim, k.alias("k"), F.col("v.size").alias("size"), strip(F.col("color")).alias("color"),
        "v.description", "v.short_description",
    )


def _expand_blocks(stage: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    texts = ["description", "short_description"]
    slim = [name for name in stage.columns if name not in ("sizes", "colors", *texts)]
    base = stage.withColumns({"k": F.lit(0).cast("bigint"), "size": none, "color": none})

    def blocks(values: str) -> Column:
        starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK_SIDE))
        return F.transform(
            starts, lambda at: F.struct(at.cast("bigint").alias("at"), F.slice(values, at + 1, BLOCK_SIDE).alias("values"))
        )

    lists = stage.select(*slim, F.split("sizes", ",").alias("size_list"), F.split(_colors(), ",").alias("color_list"))
    items = lists.select(
        *slim, F.size("color_list").cast("bigint").alias("colors_each"), blocks("color_list").alias("color_blocks"),
        F.explode(blocks("size_list")).alias("s"),
    )
    items = items.select(*slim, "colors_each", "s", F.explode("color_blocks").alias("c"))
    # a number of partitions that adaptive execution does not merge: blocks are small, their rows are not
    tasks = int(stage.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = items.repartition(tasks, "product_seq", "s.at", "c.at")
    rows = items.select(*slim, "colors_each", "c", "s.at", F.posexplode("s.values").alias("size_place", "size"))
    rows = rows.select(*slim, "colors_each", "at", "size_place", "size", F.col("c.at").alias("color_at"),
                       F.posexplode("c.values").alias("color_place", "color"))
    k = (F.col("at") + F.col("size_place")) * F.col("colors_each") + F.col("color_at") + F.col("color_place") + 1
    variations = rows.select(
        *slim, k.alias("k"), strip(F.col("size")).alias("size"), strip(F.col("color")).alias("color"),
        *(none.alias(name) for name in ("sizes", "colors", *texts)),
    )
    return base.unionByName(variations)


def to_catalog(stage: DataFrame, first_id: int = 10000) -> DataFrame:
    """Catalog rows in the 47-column layout plus ``product_seq`` and ``k``, which give the row order.

    Numbers run from ``first_id`` in row order. A variation's parent number follows from the start of its own
    product's block, so no row looks at the rows above it.
    """
    starts = number_blocks(stage, "product_seq", catalog_size(), first_id)
    # joined while a product is one row; nothing is shuffled once its variations are rows
    rows = expand_rows(stage.join(starts, "product_seq"))

    is_base, variable = F.col("k") == 0, F.col("variable")
    none, empty = F.lit(None).cast("string"), F.lit("")

    def by_kind(base: Column, variation: Column) -> Column:
        return F.when(is_base, base).otherwise(variation)

    title, sale = F.col("title"), F.col("sale_price")
    values = {
        "ID": F.col("start_id") + F.col("k"),
        "Type": by_kind(F.when(variable, F.lit("variable")).otherwise(F.lit("simple")), F.lit("variation")),
        "SKU": by_kind(F.coalesce("sku", empty), empty),
        "Name": by_kind(title, F.concat(F.coalesce(title, empty), F.lit(" - "), "size")),
        "Published": F.lit("1"),
        "Is featured?": by_kind(F.lit("0"), none),
        "Visibility in catalog": F.lit(VISIBLE),
        "Short description": by_kind(F.coalesce("short_description", empty), none),
        "Description": by_kind(F.col("description"), none),
        "In stock?": F.lit(STOCK),
        "Sale price": by_kind(F.coalesce(sale, empty), F.coalesce(sale, "regular_price")),
        "Regular price": F.when(is_base & variable, empty).otherwise(F.col("regular_price")),
        "Categories": by_kind(F.coalesce("category", F.lit(DEFAULT_CATEGORY)), none),
        "Images": by_kind(plain_image_url(F.col("images")), none),
        "Parent": by_kind(none, F.concat(F.lit("id:"), F.col("start_id"))),
        "Attribute 1 name": F.when(variable, F.lit("Size")).otherwise(empty),
        "Attribute 1 value(s)": by_kind(F.coalesce("sizes", empty), F.col("size")),
        "Attribute 1 visible": F.when(variable, F.lit("1")).otherwise(empty),
        "Attribute 1 global": F.when(variable, F.lit("1")).otherwise(empty),
        "Attribute 2 name": F.lit("Color"),
        "Attribute 2 value(s)": by_kind(_colors(), F.col("color")),
        "Attribute 2 visible": F.lit("1"),
        "Attribute 2 global": F.lit("1"),
    }
    return rows.select(
        "product_seq", "k", *(values.get(name, none).alias(name) for name in CATALOG_COLUMNS)
    )
