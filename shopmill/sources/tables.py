"""Tables that jobs read and write: stored pages, run results and the typed list of search terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmill.functions import urls
from shopmill.functions.columns import strip
from shopmill.schemas import PAGES, RUNS


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages; filters on ``page_id`` and ``url`` reach the files, and ``html`` is read only where used."""
    return spark.read.schema(PAGES).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of all jobs, with the ``run_id`` that each was written under; a filter on it reads that job's files alone."""
    return spark.read.schema(T.StructType([*RUNS.fields, T.StructField("run_id", T.StringType())])).parquet(path)


def write_runs(runs: DataFrame, path: str, run_id: str = "0") -> None:
    """Write the runs of the job ``run_id``. A job that is written again replaces its own rows and no other's.

    A table without rows replaces nothing.
    """
    rows = runs.select(*RUNS.fieldNames()).withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def search_terms(lines: DataFrame, column: str = "line") -> DataFrame:
    """``term_pos, term`` from comma-separated lines (all columns of ``lines`` but the text are kept)."""
    others = [name for name in lines.columns if name != column]
    split = lines.select(*others, F.posexplode(F.split(column, ",")).alias("term_pos", "raw"))
    return split.select(*others, F.col("term_pos").cast("long").alias("term_pos"), strip(F.col("raw")).alias("term")).filter(F.col("term") != "")


def seeds(spark: SparkSession, text: str) -> DataFrame:
    """Search terms of one typed line with their search URLs; blank terms are left out."""
    terms = search_terms(spark.createDataFrame([(text,)], "line string"))
    return terms.withColumn("search_url", urls.search_url(F.col("term")))
