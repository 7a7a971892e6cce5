"""Reports over the event table, read as a log of runs: an ``error`` event is a failed run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmill.operators import report
from shopmill.queries.registry import query, table, work_folder
from shopmill.sources.tables import read_runs, write_runs


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS term_pos",
        "concat('https://x/s?k=', user_id) AS url",
        "event_type <> 'error' AS success",
        "if(event_type = 'error', NULL, event_type) AS category_name",
        "cast(value AS decimal(12,2)) AS execution_time",
        "cast(user_id % 8 AS string) AS worker",
        "if(event_type = 'view', 0L, user_id) AS product_count",
        "if(event_type = 'error', concat('failed: ', props), NULL) AS error",
    )


@query("""
SELECT count(*) AS terms, count(*) FILTER (event_type <> 'error') AS succeeded,
       count(*) FILTER (event_type = 'error') AS failed,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_time,
       round(CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*), 4) AS average_time,
       count(*) FILTER (event_type <> 'error') || '/' || count(*) AS success_ratio,
       round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_percent
FROM events
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = report.run_summary(runs(spark, sf_dir))
    return summary.withColumns(
        {
            "total_time": F.col("total_time").cast("double"),
            "average_time": F.round(F.col("average_time").cast("double"), 4),
            "success_percent": F.round("success_percent", 4),
        }
    )


@query("SELECT 'https://x/s?k=' || user_id AS url, 'failed: ' || props AS error FROM events WHERE event_type = 'error'")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.failed_runs(runs(spark, sf_dir))


@query("""
SELECT event_id AS term_pos, 'term ' || o_custkey AS term,
       CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS status,
       CASE WHEN event_type = 'error' THEN 'N/A' ELSE event_type END AS category_name
FROM events JOIN orders ON event_id = o_orderkey
""")
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS term_pos", "concat('term ', o_custkey) AS term"
    )
    return report.run_detail(terms, runs(spark, sf_dir))


@query("""
SELECT event_type AS category_name, 'https://x/s?k=' || user_id AS url,
       CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS product_count
FROM events WHERE event_type <> 'error'
""")
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.file_report(runs(spark, sf_dir))


@query("""
SELECT event_id AS term_pos, event_type AS category_name, user_id AS product_count
FROM events WHERE event_type NOT IN ('error', 'view') AND user_id > 0
""")
def useful_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.useful_runs(runs(spark, sf_dir)).select("term_pos", "category_name", "product_count")


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END AS category_name,
       CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Success' END AS status, count(*) AS runs
FROM events GROUP BY ALL
""")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.category_summary(runs(spark, sf_dir))


@query("""
SELECT user_id % 2 AS job, event_type = 'error' AS failed, count(*) AS runs, sum(event_id) AS positions FROM events GROUP BY ALL
""")
def runs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two jobs written, one of them twice, and read back: no row is lost or doubled."""
    folder, log = work_folder(spark), runs(spark, sf_dir)
    odd = F.col("url").rlike("[13579]$")
    for job, rows in (("1", log.filter(odd)), ("0", log.filter(~odd)), ("1", log.filter(odd))):
        write_runs(rows, folder, job)
    back = read_runs(spark, folder)
    return back.groupBy(F.col("run_id").cast("long").alias("job"), (~F.col("success")).alias("failed")).agg(
        F.count("*").alias("runs"), F.sum("term_pos").alias("positions")
    )
