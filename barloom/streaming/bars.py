"""Incremental cleaning of bar files as they arrive.

The same :func:`~barloom.sources.bars.normalize_bars` runs on a file stream; it is stateless,
so no watermark or state store is needed and a restart continues from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.bars import normalize_bars


def read_bar_stream(spark: SparkSession, path: str, schema: StructType,
                    files_per_batch: int = 1000) -> DataFrame:
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
           .parquet(path))
    return normalize_bars(raw)


def append_bars(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append cleaned bars to the year-partitioned table and stop when the input is drained."""
    return (bars.withColumn("year", F.year("date")).writeStream.format("parquet")
            .partitionBy("year").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path))
