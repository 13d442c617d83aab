"""Connected components of a graph given as an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node of a neighbourhood.

    large: every node's greater neighbours; otherwise its smaller ones and itself.
    """
    e = _both_ways(edges) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
        out = e.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = e.join(least, "a").where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges``: two BIGINT columns.  Returns (node, root): every node that has an edge.

    The root is the least node of the component.  Each round is a pair of joins on the node;
    the number of rounds grows with the logarithm of a component's size.  Every round is
    written to the shared folder, so a lost executor costs no more than one round.  Only two
    numbers per round reach the driver.
    """
    left, right = edges.columns[:2]
    now = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct()
    now, seen = stage(now, label), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        now = stage(_star(_star(now, True), False), label)
