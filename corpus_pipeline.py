"""Corpus preparation from the table ``documents`` to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the
columns of ``documents``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatix.llm import jaccard_join, packing, quality_rules, secret_ledger
from verbatix.llm.common import bound_batches, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A null or empty text has no words and goes."""
    bound_batches(spark)
    return quality_rules.quality(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


#: So many numbers of rows that go (8 bytes each) are sent to all executors; more are joined by shuffle.
FEW_ROWS = 500_000


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more): that of the
    smallest doc_id, nulls last. Rows are told apart by a number of their own, as doc_id may repeat or be
    null. Texts without words link with nothing and stay."""
    bound_batches(spark)
    numbered = materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard_join.jaccard_groups(numbered, "_row").select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    ranked = groups.join(numbered.select("_row", "doc_id"), "_row").select("component_id", order.alias("order"))
    first = ranked.groupBy("component_id").agg(F.min("order").alias("first"), F.count("*").alias("size")).filter("size > 1")
    gone = materialise(ranked.join(first, "component_id").filter("order._row <> first._row").select("order._row"), "gone")
    few = gone.count() <= FEW_ROWS
    return numbered.join(F.broadcast(gone) if few else gone, "_row", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark and n_chars counted again where text changed."""
    found = secret_ledger.scan(spark, docs.select(*COLUMNS).withColumn("path", F.col("doc_id")))
    masked = found.withColumn("text", secret_ledger.redact(F.col("text"), F.col("findings")))
    n_chars = F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", n_chars).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, as ``packing.PIECES`` names them."""
    bound_batches(spark)
    return packing.pack_texts(docs)


STAGES = [("quality rules", keep_quality), ("n-gram Jaccard join", drop_near_duplicates), ("secret scan", mask_secrets), ("packing", pack_sequences)]

#: Word shingles, tokenizers and bin packing are beyond SQL: tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
