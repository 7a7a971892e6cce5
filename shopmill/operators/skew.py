"""Join a table whose keys may repeat very often with one that has each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
SPLIT_KEYS = 100_000


def join_unique(big: DataFrame, unique: DataFrame, key: str, how: str = "inner", limit: int = ROWS_PER_TASK) -> DataFrame:
    """``big`` joined with ``unique`` on ``key``, which is unique in the second table only.

    A key with more than ``limit`` rows is split: its rows get one of several salts, and its one row on the other
    side is repeated per salt. The list of split keys is broadcast; it holds the ``SPLIT_KEYS`` most frequent ones at
    most, so its size is bounded whatever the input. A key that is not split has the one salt 0, and either no more
    than ``limit`` rows or no more than one in ``SPLIT_KEYS`` of all rows. NULL keys equal nothing: their rows are
    dealt by a hash of the row.
    """
    frequent = (
        big.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > limit)
        .orderBy(F.desc("copies"), key)
        .limit(SPLIT_KEYS)
        .select(key, F.ceil(F.col("copies") / limit).cast("int").alias("salts"))
    )

    def with_salts(side: DataFrame) -> DataFrame:
        return side.join(F.broadcast(frequent), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    # the partition number parts equal rows, and unlike a row number it is the same when a task runs again
    row_hash = F.xxhash64(F.spark_partition_id(), *(F.col(f"`{name}`") for name in _hashable(big)))
    salt = F.when(F.col(key).isNull(), F.col("salt").bitwiseAND(0x7FFFFFFF))
    salt = salt.otherwise(F.pmod("salt", F.col("salts").cast("bigint")))
    left = with_salts(big.withColumn("salt", row_hash)).withColumn("salt", salt)
    left = left.withColumn("salt", F.col("salt").cast("int")).drop("salts")
    right = with_salts(unique).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.join(right, [key, "salt"], how).drop("salt")


def _hashable(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if "map<" not in field.dataType.simpleString()]
