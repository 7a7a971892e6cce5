"""Pages that keep arriving.

Extraction looks at one page at a time, so the batch operators run on a stream as they are and need no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shopmill.operators.extract import extract_products
from shopmill.schemas import PAGES


def arriving_pages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_products(pages: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the product records of new pages to a parquet table, each page once, then stop."""
    return (
        extract_products(pages, **options)
        .writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
