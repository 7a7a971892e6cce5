"""Registry of the queries, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopmill.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its equivalent SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A narrow table from which a query makes much wider rows, dealt to all tasks before it does.

    Its few bytes would otherwise be one split, and one task would make and read all pages. The number is fixed by
    the session, since adaptive execution would merge partitions by the size of the narrow rows.
    """
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def work_folder(spark: SparkSession) -> str:
    """A new folder in the place that the executors share."""
    return os.path.join(ensure_checkpoint_dir(spark), f"work-{os.urandom(8).hex()}")
