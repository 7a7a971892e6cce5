"""Reports over the table of runs (one row per search term or URL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUCCESS_LABEL, FAILED_LABEL = "Success", "Failed"


def _status() -> Column:
    return F.when(F.col("success"), F.lit(SUCCESS_LABEL)).otherwise(F.lit(FAILED_LABEL)).alias("status")


def useful_runs(runs: DataFrame) -> DataFrame:
    """Successful runs that found products."""
    return runs.filter(F.col("success") & (F.col("product_count") > 0))


def run_summary(runs: DataFrame) -> DataFrame:
    """Counts, total time, averages and success ratio of all runs; NULL averages of no runs, NULL times if none is known."""
    totals = runs.agg(
        F.count("*").alias("terms"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("execution_time").alias("total_time"),
        F.count("execution_time").alias("timed"),
    )
    return totals.select(
        *(name for name in totals.columns if name != "timed"),
        F.try_divide("total_time", "timed").alias("average_time"),
        F.concat_ws("/", "succeeded", "terms").alias("success_ratio"),
        F.try_divide(F.lit(100.0) * F.col("succeeded"), F.col("terms")).alias("success_percent"),
    )


def failed_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.col("success")).select("url", "error")


def run_detail(terms: DataFrame, runs: DataFrame) -> DataFrame:
    """Each search term with the outcome of its run; terms and runs pair up by position."""
    return terms.select("term_pos", "term").join(runs, "term_pos").select(
        "term_pos", "term", _status(), F.coalesce("category_name", F.lit("N/A")).alias("category_name")
    )


def file_report(runs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Categories that were written, with what was written for them.

    With ``files`` (see `sources.csv_files.written_files`) a row per file: ``path, bytes, rows`` besides; NULL for a
    category without a file.
    """
    found = runs.filter("success").select("category_name", "url", "product_count")
    return found if files is None else found.join(files, "category_name", "left")


def category_summary(runs: DataFrame) -> DataFrame:
    """Outcome per category; a run that never got as far as a category counts as ``Unknown``."""
    return runs.groupBy(F.coalesce("category_name", F.lit("Unknown")).alias("category_name"), _status()).agg(
        F.count("*").alias("runs")
    )
