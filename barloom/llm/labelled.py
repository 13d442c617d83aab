"""Labelled rows for learning: a bounded sample, never a held-out row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 8000          # bound on the labelled rows a model is fitted on
FOLDS, HELD_OUT = 4, 2


def held_out(key: Column) -> Column:
    """Rows kept for evaluation: crc32 of the key as text, modulo 4, is 2 (a null key is not)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str,
             rows: int = EXAMPLES) -> DataFrame:
    """(key, y, text) of at most ``rows`` labelled documents outside the held-out fold.

    The ids of least hash are taken, so the sample does not depend on partitioning; it is
    bounded, so it is broadcast.
    """
    ids = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
           .groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
           .orderBy(F.xxhash64("key"), "key").limit(rows))
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(ids), "key").select("key", "y", "text")
