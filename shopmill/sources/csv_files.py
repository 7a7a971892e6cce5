"""CSV sinks, and the CSV source that finds out how each file is encoded."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopmill.functions.urls import safe_file_name
from shopmill.operators.catalog import stage_to_csv_columns
from shopmill.operators.numbering import number_blocks
from shopmill.schemas import CATALOG_COLUMNS, STAGE_CSV
from shopmill.session import ensure_checkpoint_dir

BYTE_ORDER_MARK = "\ufeff"
# Encodings to try after UTF-8 (with or without a byte order mark), in order.
LEGACY_ENCODINGS = ["gbk", "gb18030"]
LAST_ENCODING = "iso-8859-1"
BYTES = "ISO-8859-1"
ROWS_PER_FILE = 1_000_000
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``file, encoding``: for each file the first encoding in which all its bytes are valid.

    Files are tested line by line in splits of ordinary size, so a large file is not read by one task.
    """
    lines = spark.read.text(path)
    return _encodings(lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw")))


def _encodings(lines: DataFrame) -> DataFrame:
    """The encoding of each file from its lines (``file, raw``).

    Lines may be tested alone because no listed encoding uses a line feed inside a character. Only lines that are not
    valid UTF-8 visit Python.
    """
    tested = lines.select("file", "raw", F.is_valid_utf8(F.col("raw").cast("string")).alias("utf8"))

    @F.pandas_udf("array<boolean>")
    def valid_in(raw: pd.Series) -> pd.Series:
        def decodes(value: bytes, encoding: str) -> bool:
            try:
                bytes(value).decode(encoding)
            except UnicodeDecodeError:
                return False
            return True

        return raw.map(lambda value: [decodes(value, encoding) for encoding in LEGACY_ENCODINGS])

    odd = tested.filter(~F.col("utf8")).select("file", valid_in("raw").alias("valid"))
    by_file = odd.groupBy("file").agg(
        *(F.bool_and(F.col("valid")[i]).alias(name) for i, name in enumerate(LEGACY_ENCODINGS))
    )
    chosen = F.coalesce(*(F.when(F.col(name), F.lit(name)) for name in LEGACY_ENCODINGS), F.lit(LAST_ENCODING))
    # every file has an answer: those without an odd line are UTF-8
    return (
        tested.select("file").distinct()
        .join(by_file, "file", "left")
        .select(
            "file",
            F.when(F.col(LEGACY_ENCODINGS[0]).isNull(), F.lit("utf-8")).otherwise(chosen).alias("encoding"),
        )
    )


def _kept(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _joined(parts: Column, text: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), text), "\n")


def csv_records(spark: SparkSession, path: str, work_dir: str) -> DataFrame:
    """``file, encoding, position, cells``: the records of CSV files that may hold line breaks inside quotes.

    Files are read in splits of ordinary size. A line break ends a record where the quotes before it are even, so each
    split counts its own, sums over the splits of a file say whether a split begins inside quotes, and each split cuts
    itself into records. The one or two records of a split that cross its borders are put together afterwards.

    Lines, and the pieces of records, are written under ``work_dir``, because how files are split may change from one
    scan to the next; splits bound every group. ``position`` grows from file to file (by path) and from row to row in
    a file. ``cells`` is the text of a record, decoded, without its line end. Records end with a line feed, with or
    without a carriage return; both are kept as they are inside quotes. Headers are records; blank lines are not.
    """
    # one character per byte: quotes and line feeds are the same byte in all encodings, and no part of another character
    raw = F.col("value").cast("binary")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),  # in a split, lines come in order
        raw.alias("raw"),
        (F.regexp_count(F.decode(raw, BYTES), F.lit('"')) % 2).alias("odd"),
    )
    lines = _kept(lines, f"{work_dir}/lines")

    earlier_blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd")).select(
        "file", "block", F.coalesce(F.sum("odd").over(earlier_blocks), F.lit(0)).alias("opened")
    )
    in_block = Window.partitionBy("file", "block").orderBy("place")
    quotes = F.col("opened") + F.coalesce(F.sum("odd").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(opened, ["file", "block"]).withColumn("starts", F.when(quotes % 2 == 0, 1).otherwise(0))
    marked = marked.withColumn("record", F.sum("starts").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    # the window's partitioning serves the grouping as well; record 0 began in an earlier split
    pieces = marked.groupBy("file", "block", "record").agg(
        ((F.sum("odd") % 2 == 1) | (F.col("record") == 0)).alias("crosses"),
        _joined(F.collect_list(F.struct("place", "raw")), lambda line: F.decode(line["raw"], BYTES)).alias("bytes"),
    )
    pieces = _kept(pieces, f"{work_dir}/pieces")

    crossing = pieces.filter("crosses")
    owner = F.when(F.col("record") > 0, F.struct("block", "record"))
    in_file = Window.partitionBy("file").orderBy("block", "record")
    merged = (
        crossing.withColumn("owner", F.last(owner, ignorenulls=True).over(in_file))
        .groupBy("file", "owner")
        .agg(_joined(F.collect_list(F.struct("block", "record", "bytes")), lambda piece: piece["bytes"]).alias("bytes"))
        .select("file", "owner.block", "owner.record", "bytes")
    )
    records = pieces.filter("not crosses").select("file", "block", "record", "bytes").unionByName(merged)

    counts = pieces.groupBy("file", "block").agg(F.max("record").alias("records"))
    starts = number_blocks(counts.select(F.struct("file", "block").alias("at"), "records"), "at", F.col("records"), -1)
    records = records.join(starts.select("at.file", "at.block", "start_id"), ["file", "block"])
    # rows of a line per file and of a row per split meet the records; Spark broadcasts them while they are small
    records = records.join(_kept(_encodings(lines), f"{work_dir}/encodings"), "file").select(
        "file",
        "encoding",
        (F.col("start_id") + F.col("record")).alias("position"),
        F.regexp_replace("bytes", r"\r\z", "").alias("bytes"),
    )
    records = records.filter(F.col("bytes") != "")

    @F.pandas_udf("string")
    def decoded(raw: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([bytes(r).decode(e) for r, e in zip(raw, encoding)], dtype=object)

    whole = F.encode("bytes", BYTES)
    legacy = F.col("encoding").isin(LEGACY_ENCODINGS)
    easy = F.when(F.col("encoding") == LAST_ENCODING, F.col("bytes")).otherwise(F.decode(whole, "UTF-8"))
    columns = ["file", "encoding", "position"]
    return records.filter(~legacy).select(*columns, easy.alias("cells")).unionByName(
        records.filter(legacy).select(*columns, decoded(whole, "encoding").alias("cells"))
    )


def read_stage_csv(spark: SparkSession, path: str, work_dir: str | None = None) -> DataFrame:
    """Staging files of any of the known encodings, every cell a string, plus ``file`` and ``position``.

    ``position`` is the row order over all files, see `csv_records`. Each file's first record is its header.
    Without a ``work_dir``, a new folder beside the session's checkpoints is used.
    """
    work_dir = work_dir or f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    records = csv_records(spark, path, work_dir)
    first = records.groupBy("file").agg(F.min("position").alias("header"))
    schema = ", ".join(f"`{name}` string" for name in STAGE_CSV.fieldNames())
    rows = records.join(first, "file").filter(F.col("position") > F.col("header"))
    cells = F.from_csv("cells", schema, CSV_OPTIONS | {"multiLine": "true"})
    return rows.select("file", "position", cells.alias("c")).select("c.*", "file", "position")


def _with_mark(df: DataFrame, first: str) -> DataFrame:
    """Put the byte order mark in front of the header, where spreadsheet programs look for it."""
    return df.withColumnRenamed(first, BYTE_ORDER_MARK + first)


def write_stage(stage: DataFrame, folder: str, stamp: Column | str) -> None:
    """One folder per category, named after it and the stamp.

    Rows are in order of category and ``product_seq``, within a file and from each file of a category to the next;
    ranges split a category that holds much of the data into several files.
    """
    stamp = F.lit(stamp) if isinstance(stamp, str) else stamp
    name = F.concat(safe_file_name(F.coalesce("category", F.lit(""))), F.lit("_products_"), stamp)
    rows = stage.withColumn("file", name).repartitionByRange("file", "product_seq")
    rows = stage_to_csv_columns(rows.sortWithinPartitions("file", "product_seq"), "file")
    _with_mark(rows, "Title").write.partitionBy("file").options(**CSV_OPTIONS).option(
        "maxRecordsPerFile", ROWS_PER_FILE
    ).mode("overwrite").csv(folder)


def written_files(spark: SparkSession, folder: str) -> DataFrame:
    """``category_name, path, bytes, rows`` per file that `write_stage` wrote into ``folder``, from the files themselves.

    Names of categories can differ in characters that file names cannot hold; a file that holds rows of several
    categories is listed once for each, with its rows of that category. Only the category of each row is parsed out.
    """
    # files that this library writes are UTF-8
    reader = spark.read.schema(STAGE_CSV).options(**CSV_OPTIONS, multiLine="true", enforceSchema="true")
    cells = reader.csv(f"{folder}/*/*.csv").select(
        F.col("Category").alias("category_name"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("bytes"),
    )
    return cells.groupBy("category_name", "path", "bytes").agg(F.count("*").alias("rows")).select(
        "category_name", "path", "bytes", "rows"
    )


def write_catalog(catalog: DataFrame, folder: str) -> None:
    """Catalog files in row order: within a file, and from each file to the next."""
    ordered = catalog.repartitionByRange("product_seq", "k").sortWithinPartitions("product_seq", "k")
    _with_mark(ordered.select(*CATALOG_COLUMNS), "ID").write.options(**CSV_OPTIONS).option(
        "maxRecordsPerFile", ROWS_PER_FILE
    ).mode("overwrite").csv(folder)
