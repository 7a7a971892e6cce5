"""The corpus pipeline: documents in, packed training sequences out, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmill.llm import exact_dedup, mixing, packing, quality, simhash
from shopmill.llm.common import work_folder, without
from shopmill.llm.queries import DOMAINS, WEIGHTS, digest_index


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score(model) >= quality.THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; rows without a doc_id pass."""
    found = exact_dedup.deduplicate(docs, digest_index(spark))
    return without(docs, found.filter("not kept and doc_id is not null"), "doc_id")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows without a doc_id pass."""
    found = simhash.near_duplicates(docs)
    return without(docs, found.filter("not is_kept and doc_id is not null"), "doc_id")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture: three quarters of all tokens, no document twice; rows without a doc_id pass."""
    mixed = mixing.mix(docs, WEIGHTS, DOMAINS, share=(3, 4), epochs=1)
    return without(docs, mixed.filter("copies = 0 and doc_id is not null"), "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the trees, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
