"""Table layouts. Missing values are NULL inside the library and become text only at the CSV sinks."""

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

MONEY = T.DecimalType(12, 2)

PRICE = T.StructType(
    [
        T.StructField("current_price", MONEY),
        T.StructField("original_price", MONEY),
        T.StructField("deal_price", MONEY),
        T.StructField("price_range", T.StructType([T.StructField("min", MONEY), T.StructField("max", MONEY)])),
        T.StructField(
            "savings",
            T.StructType([T.StructField("amount", MONEY), T.StructField("percentage", T.DecimalType(5, 2))]),
        ),
        T.StructField("prime_price", MONEY),
        T.StructField("installment", MONEY),
        T.StructField("coupon", MONEY),
    ]
)

PRODUCT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("price", PRICE),
        T.StructField("rating", T.DoubleType()),
        T.StructField("review_count", T.LongType()),
        T.StructField("description", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("availability", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("term_pos", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("execution_time", T.DoubleType()),
        T.StructField("worker", T.StringType()),
        T.StructField("product_count", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

# Header of the staging CSV.
STAGE_COLUMNS = [
    "Title", "Description", "Short description", "Regular price", "Sale_Price",
    "Category", "Images", "SKU", "Sizes", "Color",
]

STAGE_CSV = T.StructType([T.StructField(name, T.StringType()) for name in STAGE_COLUMNS])

# Header of the shop import CSV.
CATALOG_COLUMNS = [
    "ID", "Type", "SKU", "Name", "Published", "Is featured?", "Visibility in catalog",
    "Short description", "Description", "Date sale price starts", "Date sale price ends",
    "Tax status", "Tax class", "In stock?", "Stock", "Low stock amount",
    "Backorders allowed?", "Sold individually?", "Weight (kg)", "Length (cm)",
    "Width (cm)", "Height (cm)", "Allow customer reviews?", "Purchase note",
    "Sale price", "Regular price", "Categories", "Tags", "Shipping class",
    "Images", "Download limit", "Download expiry days", "Parent", "Grouped products",
    "Upsells", "Cross-sells", "External URL", "Button text", "Position",
    "Attribute 1 name", "Attribute 1 value(s)", "Attribute 1 visible",
    "Attribute 1 global", "Attribute 2 name", "Attribute 2 value(s)",
    "Attribute 2 visible", "Attribute 2 global",
]
