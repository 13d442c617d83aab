"""Result sinks: a run is five tables side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame

RESULT_TABLES = ("metrics", "equity", "monthly", "trades", "by_stock")


def write_result(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Write the tables of one run as parquet under ``path/<table>``."""
    unknown = set(tables) - set(RESULT_TABLES)
    if unknown:
        raise ValueError(f"unknown result tables: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
