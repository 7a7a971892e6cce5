"""Small helpers of the pipeline operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmill.session import ensure_checkpoint_dir

#: The white space that contracts call ``[\x20\x09-\x0D]``: ASCII only, so that no locale or Unicode table matters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{os.urandom(8).hex()}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    It cuts the lineage like a checkpoint, but runs the plan once, and its rows survive the loss of any executor.
    """
    spark = df.sparkSession
    folder = work_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def whole_text(name: str = "text") -> Column:
    """The text of a row; a null text counts as an empty one."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fold(key: str, count: int) -> Column:
    """The remainder that splits rows into folds: crc32 of the key as text modulo ``count``."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % count


def key_type(df: DataFrame, key: str) -> T.DataType:
    return df.schema[key].dataType


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not among those of ``dropped``; rows with a null key stay.

    The keys to drop are few and narrow. Spark picks the join by the measured size of that side: broadcast while it is
    below its threshold, else a sort-merge join that moves each row once.
    """
    return df.join(dropped.select(key).distinct(), key, "left_anti").select(*(f"`{c}`" for c in df.columns))
