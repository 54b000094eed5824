"""A corpus pipeline over the table documents: five stages, each by one operator of ``mediaops.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.llm.common import fresh, read_table
from mediaops.llm.exact_dedup import drop_exact_duplicates, rows_that_stay
from mediaops.llm.mixing import mix_sources
from mediaops.llm.packing import pack_documents
from mediaops.llm.simhash import near_duplicate_rows
from mediaops.llm.toxicity import keep_clean, train
from mediaops.plans.staging import cut_lineage, scratch_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labels of ``docs``, does not reject."""
    return keep_clean(docs, train(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return drop_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest id.

    SimHash fingerprints meet through Golay keys as in ``op5_simhash_dedup``, and an exact comparison of the sets of shingles
    follows.  Three bits do not reach every pair at this similarity; minima of the sets find the others.

    Of rows with the same id, or of a group without ids, the text with the least sha256 stays.
    """
    found = near_duplicate_rows(docs).select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "kept")
    return rows_that_stay(docs, cut_lineage(found))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; labels of quality weigh the choice.

    A row is known by its id, source and text, null or not.  Rows that repeat all three are one row here, which comes as
    often as the mix takes them together.  A null text counts as empty.
    """
    key, source, md5, times, n, copy = names = fresh(docs, "_key", "_source", "_md5", "_times", "_n", "_copy")
    mixed = mix_sources(docs, read_table(spark, sf_dir, "labels"))
    mixed = mixed.groupBy(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("text_md5").alias(md5))
    taken = cut_lineage(mixed.agg(F.sum("times").alias(times), F.count(F.lit(1)).alias(n)).filter(F.col(times) > 0))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    joined = docs.join(taken, same & (F.md5(F.coalesce("text", F.lit(""))) == F.col(md5)))
    if not taken.filter(F.col(n) > 1).isEmpty():
        again = joined.filter(F.col(n) > 1).dropDuplicates([key, source, md5])
        joined = joined.filter(F.col(n) == 1).unionByName(again)
    repeated = joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return repeated.drop(*names).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# A learned classifier, fingerprints and a tokenizer have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = f"{scratch_folder(spark)}-{name}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(folder)
        docs = spark.read.schema(result.schema).parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
