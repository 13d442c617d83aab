"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, packing.

Each stage takes the Parquet its predecessor wrote and keeps the columns of ``documents``;
the last one returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontamination, packing, quality_rules, secret_scan, similar_sets
from barloom.llm.queries import table
from barloom.sources.staging import stage, staging_root

# Learned ratios and token ids have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep.

    Null and empty texts are rejected (no words); repeated rows and null keys are judged like
    others.  Columns are left as they are.  An empty table stays empty.
    """
    return quality_rules.kept_rows(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more.

    SimHash signatures link most copies, an exact join over the shingle sets the rest.  The one
    with the least key stays, a null key only where a group has no other; rows that repeat that
    key and text are copies.  Texts without words are one group.  Columns are left as they are.
    """
    return similar_sets.drop_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.  Null and empty texts hold none and stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by a mark; ``n_chars`` follows the text.

    A null text stays null, and so does its ``n_chars``.
    """
    ledger = f"{staging_root(spark)}/barloom-{uuid.uuid4().hex}/blob-ledger"
    masked = secret_scan.mask_secrets(docs, ledger)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left; a null or empty text is the end id alone."""
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


STAGES = [("quality_rules", keep_quality), ("simhash_dedup", keep_one_of_near_copies),
          ("decontamination", drop_benchmark), ("secret_scan", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again.

    An empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
