"""Exact percentiles by distributed rank selection.

Values are counted (map-side first), the counts are range-sorted over all tasks, and every task's
total tells the ranks it holds.  A percentile lies between two neighbouring ranks; only the tasks
that hold such a rank are looked at again.  No task ever holds all values, and a value that a
third of all rows carry is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n): how often each known value of each column occurs; NaN is unknown."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v"))
                      for c in columns])
    return (df.select(F.inline(pairs)).where(F.col("v").isNotNull() & ~F.isnan("v"))
            .groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(df: DataFrame, columns: list[str], points: list[float]) -> DataFrame:
    """(column, n, q): number of known values and their percentiles in the order of ``points``.

    Between two ranks the value is interpolated linearly.  A column without a known value has no
    row.  The sorted counts are written once to the shared folder, as ranks and picks read them.
    """
    if not points or not all(0.0 <= p <= 1.0 for p in points):
        raise ValueError("points lie between 0 and 1")
    counts = value_counts(df, columns).repartitionByRange("column", "v")
    counts = stage(counts.withColumn("task", F.spark_partition_id()), "value-counts")
    # one row per task and column
    tasks = counts.groupBy("column", "task").agg(F.sum("n").alias("held"))
    every = Window.partitionBy("column")
    before = every.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumns({"first": F.coalesce(F.sum("held").over(before), F.lit(0)),
                               "total": F.sum("held").over(every)})
    place = F.lit(0.0) + F.col("point") * (F.col("total") - 1)
    wanted = tasks.select("*", F.posexplode(F.array(*map(F.lit, points))).alias("at", "point"))
    wanted = (wanted.withColumn("place", place)
              .select("column", "task", "total", "at", "place",
                      F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))
                      .alias("rank"), "first", "held")
              .where("rank >= first AND rank < first + held"))
    # ranks inside the tasks that hold a wanted one
    up_to = Window.partitionBy("column", "task").orderBy("v").rowsBetween(
        Window.unboundedPreceding, 0)
    inside = (counts.join(wanted.select("column", "task").distinct(), ["column", "task"], "left_semi")
              .withColumn("end", F.sum("n").over(up_to)))
    local = F.col("rank") - F.col("first")
    hit = inside.join(wanted, ["column", "task"]).where(
        (local < F.col("end")) & (local >= F.col("end") - F.col("n")))
    picked = hit.groupBy("column", "total", "at", "place").agg(
        F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    # equal neighbours may be infinite
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(value)
    return picked.groupBy("column", F.col("total").alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", value.alias("v")))),
                    lambda x: x["v"]).alias("q"))
