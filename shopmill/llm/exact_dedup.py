"""Exact copies of texts, found through a digest index that is kept from run to run."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmill.llm.common import WHITE_SPACE, saved, whole_text, work_folder


def normalised(text: str = "text") -> Column:
    """The text with every run of ASCII white space as one space; a null text is empty."""
    return F.regexp_replace(whole_text(text), WHITE_SPACE, " ")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digest``: SHA-256 of the normalised text, 32 bytes. Texts go no further than this."""
    hexed = F.sha2(normalised(text), 256)
    return docs.select(F.col(f"`{key}`").alias(key), F.unhex(hexed).alias("digest"))


#: Buckets of an index that is not told how many.
BUCKETS = 64


class DigestIndex:
    """A table ``digest, keep_id``, bucketed and sorted by digest, in a folder that outlives the session.

    A digest is in it once, with the smallest key of the batch that brought it. New digests are found by a sort-merge
    anti-join for which only the batch is shuffled, never the index, and appended in the same buckets.

    The number of buckets is written beside the folder by the first session that opens it. It is a property of the
    files: later ones may leave it out, and get a ``ValueError`` if they give another. Every batch adds a file to each
    bucket; `compact` makes one again, whose sort order Spark then uses.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, key: str = "bigint"):
        self.spark, self.folder = spark, folder or work_folder(spark)
        given = buckets if folder is None else self._stored()
        if given is None:
            given = buckets or BUCKETS
        elif buckets not in (None, given):
            raise ValueError(f"the index in {folder} has {given} buckets, not {buckets}")
        self.buckets, self.key = given, key
        if folder is None or self._stored() is None:
            spark.range(1).select(F.lit(given).alias("buckets")).write.parquet(f"{self.folder}-layout")
        self.name = f"digest_index_{os.urandom(8).hex()}"
        spark.sql(
            f"create table {self.name} (digest binary, keep_id {key}) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.folder}'"
        )

    def _stored(self) -> int | None:
        """The number of buckets that the folder's files have; None for a new folder."""
        try:
            return self.spark.read.schema("buckets int").parquet(f"{self.folder}-layout").first()["buckets"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def compact(self, folder: str | None = None) -> DigestIndex:
        """The same index in a new folder, with one file per bucket."""
        copy = DigestIndex(self.spark, folder, self.buckets, self.key)
        copy._write(self.table())
        return copy

    def _write(self, rows: DataFrame) -> None:
        writer = rows.repartition(self.buckets, "digest").write.format("parquet").mode("append")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> DataFrame:
        """Add what is new of ``batch(digest, keep_id)``, which has each digest once; returns the new rows."""
        new = saved(batch.hint("merge").join(self.table().select("digest").hint("merge"), "digest", "left_anti"))
        self._write(new)
        return new


def deduplicate(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row of ``docs``, which joins the index.

    ``keep_id`` is the key under which the text is in the index: of an earlier batch if that had the text, else the
    smallest of this batch. ``group_size`` counts the rows of this batch with the text. ``kept`` is true for the row
    that stays.

    Null texts are empty texts. Rows with a null key count, but stay only as ``kept = false``: a text that has no key
    at all gets a null ``keep_id``. Rows that repeat the kept key with the same text are all marked kept, since
    nothing tells them apart. Other columns are ignored; an empty table gives an empty result.

    Copies are counted with partial sums before the shuffle. The join back to the rows has an exchange on both sides,
    so adaptive execution can split the rows of a text that is a third of the table.
    """
    rows = saved(digests(docs, key, text))
    groups = saved(rows.groupBy("digest").agg(F.min(key).alias("keep_id"), F.count("*").alias("group_size")))
    index.append(groups.filter("keep_id is not null").select("digest", "keep_id"))
    held = index.table().select("digest", F.col("keep_id").alias("held"))
    named = saved(groups.drop("keep_id").hint("merge").join(held.hint("merge"), "digest", "left"))
    return rows.join(named, "digest").select(
        key,
        F.col("held").alias("keep_id"),
        "group_size",
        F.coalesce(F.col(key) == F.col("held"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
