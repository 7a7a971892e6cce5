"""Dense numbers in row order without sorting the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmill.session import ensure_checkpoint_dir


def number_blocks(df: DataFrame, key: str, size: Column, first: int) -> DataFrame:
    """``key, start_id``: the first number of the ``size`` consecutive numbers of each key, in key order.

    Only the key and the size are sorted. The sorted keys are checkpointed in the shared folder, because a
    partition that is computed again may not hold the same keys; sums per partition (a row per partition, which
    bounds the broadcast) then give each partition its start.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # a name of its own: the checkpointed table must not share a column with the table that the starts are joined to
    ordered = (
        df.select(F.col(key).alias("block_key"), size.cast("bigint").alias("size"))
        .repartitionByRange("block_key")
        .sortWithinPartitions("block_key")
        .checkpoint()
        .withColumn("part", F.spark_partition_id())
    )
    earlier_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("part")
        .agg(F.sum("size").alias("rows"))
        .select("part", F.coalesce(F.sum("rows").over(earlier_parts), F.lit(0)).alias("before"))
    )
    earlier_rows = Window.partitionBy("part").orderBy("block_key").rowsBetween(Window.unboundedPreceding, -1)
    within = ordered.select("block_key", "part", F.coalesce(F.sum("size").over(earlier_rows), F.lit(0)).alias("offset"))
    return within.join(F.broadcast(starts), "part").select(
        F.col("block_key").alias(key), (F.col("before") + F.col("offset") + first).alias("start_id")
    )
