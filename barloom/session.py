"""Session helper. Only sets what is unset, so a cluster's own configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app_name: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: str | int = "*", memory: str = "6g", **conf: str) -> SparkSession:
    """Single-machine session used by tests and ``bench.py``."""
    parts = "8" if cores == "*" else str(cores)
    spark = get_session(
        master=f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": parts,
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            # call-site capture makes every Column expression slow to build
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            **conf,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
