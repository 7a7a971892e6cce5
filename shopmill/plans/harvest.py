"""The whole job: search terms and stored pages to catalog rows and a table of runs."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmill.functions import urls
from shopmill.operators.catalog import stage_from_csv_columns, to_catalog, to_stage
from shopmill.operators.extract import extract_products
from shopmill.operators.quarantine import NOTHING_FOUND, only_pages, readable, route_pages
from shopmill.operators.rank import search_link_lists
from shopmill.operators.skew import join_unique
from shopmill.session import HarvestSettings
from shopmill.sources.csv_files import read_stage_csv


@dataclass
class Harvest:
    """Tables of one run."""

    products: DataFrame
    stage: DataFrame
    runs: DataFrame
    #: ``page_id, url, reason``: stored pages that cannot be used and have to be fetched again.
    refetch: DataFrame
    #: ``page_id``: the pages that were taken apart.
    parsed: DataFrame
    first_catalog_id: int

    @cached_property
    def catalog(self) -> DataFrame:
        """Numbered catalog rows; the numbers are settled when this is first asked for."""
        return to_catalog(self.stage, self.first_catalog_id)


def _products(
    pages: DataFrame, copies: DataFrame, work_dir: str, at: Column | None, limit: int
) -> tuple[DataFrame, DataFrame]:
    """One record per product of ``copies(page_id, url, asin)``, that of the newest page that gives one, and what was read.

    The second table has ``page_id, url, found``. The newest copy of each product is read first; older copies are
    read only for products whose newest page has neither title nor price.
    """

    def read(wanted: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        wanted = written(wanted.select("page_id", "url", "asin"), os.path.join(work_dir, f"{name}_pages"))
        records = extract_products(only_pages(pages, wanted), at=at, description_limit=limit)
        records = written(records, os.path.join(work_dir, f"{name}_records"))
        got = wanted.join(records.select("page_id", F.lit(True).alias("found")), "page_id", "left")
        return records, got.withColumn("found", F.coalesce("found", F.lit(False)))

    newest = copies.groupBy("asin").agg(F.max("page_id").alias("page_id"), F.max_by("url", "page_id").alias("url"))
    first, tried = read(newest, "newest")
    missing = tried.filter(~F.col("found"))
    if missing.isEmpty():
        return first, tried.select("page_id", "url", "found")
    rest = copies.join(missing.select("asin"), "asin", "left_semi").join(missing.select("page_id"), "page_id", "left_anti")
    second, tried_again = read(rest, "older")
    latest = F.max_by(F.struct(*second.columns), "page_id").alias("r")
    products = first.unionByName(second.groupBy("asin").agg(latest).select("r.*"))
    return products, tried.unionByName(tried_again).select("page_id", "url", "found")


def harvest(
    spark: SparkSession,
    terms: DataFrame,
    pages: DataFrame,
    work_dir: str,
    at: Column | None = None,
    settings: HarvestSettings = HarvestSettings(),
) -> Harvest:
    """Run the job over ``terms(term_pos, term)`` and ``pages(page_id, url, html)``.

    A first pass over the pages routes each by string tests: pages that cannot be read go to ``refetch`` with a
    reason. What is read then follows from narrow tables: the newest readable copy of each search page that a term
    asks for, and of each product that their lists name. No other page is taken apart. HTML does not move (see
    `only_pages`). Routes, link lists, products, staging rows and runs are written under ``work_dir`` (a folder that
    all executors share), so the steps after them start from tables and neither parse a page again nor depend on an
    executor that may be lost.
    """
    n = settings.products_per_page
    seeds = terms.withColumn("search_url", urls.search_url(F.col("term")))
    routes = written(route_pages(pages), os.path.join(work_dir, "routes"))
    pages = pages.withColumn("url", urls.rewrite_host(F.col("url")))

    asked = readable(routes).withColumnRenamed("url", "search_url").join(seeds, "search_url", "left_semi")
    # of several stored copies of a search page the newest counts
    search_ids = written(
        asked.groupBy("search_url").agg(F.max("page_id").alias("page_id")), os.path.join(work_dir, "search_pages")
    )
    search_pages = only_pages(pages, search_ids).withColumnRenamed("url", "search_url")
    lists = search_link_lists(search_pages, n, keep=("search_url",))
    lists = lists.select("search_url", F.col("p.links").alias("links"), F.lit(True).alias("stored"))
    lists = written(lists, os.path.join(work_dir, "links"))
    searched = join_unique(seeds, lists, "search_url", "left")

    named = lists.select(F.explode("links.asin").alias("asin")).distinct()
    copies = readable(routes).withColumn("asin", urls.extract_asin(F.col("url")))
    products, tried = _products(
        pages, copies.join(named, "asin", "left_semi"), work_dir, at, settings.description_limit
    )
    products = written(products, os.path.join(work_dir, "products"))
    refused = tried.filter(~F.col("found")).select("page_id", "url", F.lit(NOTHING_FOUND).alias("reason"))
    refetch = routes.filter(F.col("reason").isNotNull()).unionByName(refused)
    parsed = search_ids.select("page_id").unionByName(tried.select("page_id"))
    # staging fields are worked out once per product, not once per list that the product stands in
    staged = to_stage(products, key="asin", limit=settings.short_description_limit)
    wanted = searched.select("term_pos", "search_url", F.posexplode("links").alias("place", "l")).select(
        urls.category_from_search_url(F.col("search_url")).alias("category"),
        (F.col("term_pos").cast("bigint") * n + F.col("place")).alias("product_seq"),
        F.col("l.asin").alias("sku"),
    )
    found = join_unique(wanted, staged.drop("product_seq", "category"), "sku").select(*staged.columns)
    stage = written(found, os.path.join(work_dir, "stage"))

    counts = stage.groupBy(F.expr(f"product_seq div {n}").alias("term_pos")).agg(
        F.count("*").alias("product_count")
    )
    success = F.col("stored").isNotNull()
    runs = searched.join(counts, "term_pos", "left").select(
        "term_pos",
        F.col("search_url").alias("url"),
        success.alias("success"),
        F.when(success, urls.category_from_search_url(F.col("search_url"))).alias("category_name"),
        F.lit(None).cast("double").alias("execution_time"),
        F.lit(None).cast("string").alias("worker"),
        F.coalesce("product_count", F.lit(0)).alias("product_count"),
        F.when(~success, F.lit("no readable page is stored for this URL")).alias("error"),
    )
    runs = written(runs, os.path.join(work_dir, "runs"))
    return Harvest(products, stage, runs, refetch, parsed, settings.first_catalog_id)


def written(df: DataFrame, folder: str) -> DataFrame:
    """The same rows, from a table that the steps to come can read as often as they like."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def catalog_from_csv(spark: SparkSession, path: str, work_dir: str, first_id: int = 10000) -> DataFrame:
    """Catalog rows of stored staging files, whatever known encoding each has, in order of file and row."""
    cells = read_stage_csv(spark, path, os.path.join(work_dir, "csv"))
    rows = stage_from_csv_columns(cells, F.col("position"))
    return to_catalog(written(rows, os.path.join(work_dir, "stage_rows")), first_id)
