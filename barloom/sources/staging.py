"""Intermediate tables in the cluster's shared folder.

Operators that use one intermediate result several times write it once as parquet instead
of recomputing it.  The folder is the one the session names in ``spark.checkpoint.dir``;
lost executors can re-read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# (table, folder) of what the innermost ``discarding`` block has staged so far
_made: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("made", default=None)


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    folder = f"{staging_root(spark)}/barloom-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{label}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{label}")
    if _made.get() is not None:
        _made.get().append((out, folder))
    return out


@contextmanager
def discarding(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables staged in the block when it ends, also those of called functions.

    The block gets a function that keeps a staged table, for the surrounding block or for good:
    whatever is read after the block must be kept.
    """
    made, outer = [], _made.get()
    token = _made.set(made)

    def keep(df: DataFrame) -> DataFrame:
        entry = next(e for e in made if e[0] is df)
        made.remove(entry)
        if outer is not None:
            outer.append(entry)
        return df

    try:
        yield keep
    finally:
        _made.reset(token)
        for _, folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
