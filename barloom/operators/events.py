"""Reference-day scans: which (symbol, day) rows become events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import symbol_window
from ..functions.indicators import sma
from ..functions.predicates import known

EVENT_COLUMNS = ["code", "date", "amount", "open", "high", "low", "close"]


def amount_spike(spike: Column | float, prev_max: Column | float | None = None) -> Column:
    """Traded value at or above ``spike``; optionally after a quiet, live previous day."""
    w = symbol_window()
    hit = F.col("amount") >= spike
    if prev_max is not None:
        quiet = F.lag("amount").over(w) <= prev_max
        hit = hit & quiet & ~F.coalesce(F.lag("halted").over(w), F.lit(True))
    return known(hit)


def volume_spike(period: int = 20, multiple: float = 3.0) -> Column:
    """Volume at or above a multiple of its own moving average (today included)."""
    return known(F.col("volume") >= multiple * sma("volume", period))


def range_breakout(period: int = 20) -> Column:
    """Close above the highest high of the previous ``period`` bars."""
    before = symbol_window().rowsBetween(-period, -1)
    top = F.when(F.count("high").over(before) == period, F.max("high").over(before))
    return known(F.col("close") > top)


def every_bar() -> Column:
    return F.lit(True)


def scan(bars: DataFrame, rule: Column, start=None, columns: list[str] | None = None) -> DataFrame:
    """Live bars of the period where ``rule`` holds; the rule still sees earlier bars."""
    hit = bars.withColumn("_hit", rule).where(F.col("_hit") & ~F.col("halted"))
    if start is not None:
        hit = hit.where(F.col("date") >= F.lit(start).cast("date"))
    return hit.select(*(columns or EVENT_COLUMNS))


def flag_events(bars: DataFrame, rule: Column, start=None) -> DataFrame:
    """All bars with a boolean ``is_event`` (the form the trade matching needs)."""
    live = known(rule) & ~F.col("halted")
    if start is not None:
        live = live & (F.col("date") >= F.lit(start).cast("date"))
    return bars.withColumn("is_event", live)


def candidate_symbols(bars: DataFrame, cheap: Column) -> DataFrame:
    """Bars of symbols for which a single-row necessary condition holds at least once.

    Catalyst cannot move a row filter through a window, so the symbol set is reduced first
    with a semi-join.  Spark picks broadcast or shuffle from the size of the symbol set.
    """
    hot = bars.where(known(cheap)).select("code").distinct()
    return bars.join(hot, "code", "left_semi")


def only_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    return df.join(symbols.select("code").distinct(), "code", "left_semi")


def carry_forward(bars: DataFrame, cal: DataFrame, columns: list[str]) -> DataFrame:
    """Every symbol on every trading day from its first bar on, last known values carried.

    Each bar is unrolled over the days until the symbol's next bar (or the end of the
    calendar), so no symbol x day grid is joined: the output itself is the only growth.
    """
    w = symbol_window()
    # one row per trading day: the un-partitioned window stays small
    days = cal.withColumn("_last", F.max("day_idx").over(Window.partitionBy(F.lit(1))))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    known_values = {c: F.last(c, ignorenulls=True).over(so_far) for c in columns}
    b = (bars.join(F.broadcast(days), "date").withColumns(known_values)
         .withColumn("_until", F.coalesce(F.lead("day_idx").over(w) - 1, F.col("_last"))))
    days = b.select("code", *columns, F.col("date").alias("bar_date"),
                    F.explode(F.sequence("day_idx", "_until")).alias("day_idx"))
    return days.join(F.broadcast(cal), "day_idx").select(
        "code", "date", "day_idx", "bar_date", *columns)
