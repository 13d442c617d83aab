"""Split / bonus-issue price adjustment and price-event flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import symbol_window

# Share-count jump that suggests a split, and the price-continuity band.
SPLIT_RATIO = 1.5
CONTINUITY_LOW, CONTINUITY_HIGH = 0.7, 1.3
# Fixed value: exchange daily price limit, percent.
PRICE_LIMIT_PCT = 30.0

PRICES = ["open", "high", "low", "close"]
ADDED = ["share_ratio", "split_candidate", "split_event", "factor"]


def split_flags(bars: DataFrame) -> DataFrame:
    """Adds ``share_ratio``, ``split_candidate`` and ``split_event`` to every bar."""
    w = symbol_window()
    before = F.lag("stocks").over(w)
    ratio = F.when((before > 0) & (F.col("stocks") > 0), F.col("stocks") / before)
    continuity = F.try_divide(F.col("close"), F.lag("close").over(w)) * ratio
    jump = F.coalesce((ratio >= SPLIT_RATIO) | (ratio <= 1.0 / SPLIT_RATIO), F.lit(False))
    smooth = F.coalesce(continuity.between(CONTINUITY_LOW, CONTINUITY_HIGH), F.lit(False))
    return (bars.withColumns({"share_ratio": ratio, "split_candidate": jump,
                              "split_event": jump & smooth}))


def adjustment_factor(bars: DataFrame) -> DataFrame:
    """Adds ``factor`` = 1 / product of the share ratios of all *later* split events.

    The later bars are read as a running frame over descending dates, which is linear; a
    frame that ends at unbounded following is quadratic per symbol.
    """
    later = (Window.partitionBy("code").orderBy(F.desc("date"))
             .rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("split_event"), F.col("share_ratio")).otherwise(F.lit(1.0))
    flagged = split_flags(bars)
    return flagged.withColumn("factor", F.lit(1.0) / F.coalesce(F.product(step).over(later),
                                                               F.lit(1.0)))


def adjust_prices(bars: DataFrame, keep_flags: bool = False) -> DataFrame:
    """Scale only open/high/low/close so a split leaves no jump; volume stays as traded."""
    out = adjustment_factor(bars)
    out = out.withColumns({c: F.col(c) * F.col("factor") for c in PRICES if c in bars.columns})
    return out if keep_flags else out.drop(*ADDED)


def factor_steps(bars: DataFrame) -> DataFrame:
    """(code, date, ratio): the split events of all bars, the steps of the factor.

    A symbol has a handful of them, however long its history; only four columns are read.
    """
    return (split_flags(bars.select("code", "date", "close", "stocks")).where("split_event")
            .select("code", "date", F.col("share_ratio").alias("ratio")))


def scale_by_steps(bars: DataFrame, steps: DataFrame) -> DataFrame:
    """Prices of ``bars`` scaled by 1 / product of the ratios of all later ``steps``.

    As :func:`adjust_prices`, but the steps may come from more bars than are scaled: a range of
    days gets the factors of the whole history, so prices refer to the newest day whatever the
    range.  Union and one running product per symbol over descending days, which is an as-of
    step join with one exchange; the bars need neither ``stocks`` nor the days of the splits.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in bars.columns])
    ones = bars.select("code", "date", F.lit(0).alias("_side"), F.lit(1.0).alias("_step"),
                       row.alias("_bar"))
    none = F.lit(None).cast(ones.schema["_bar"].dataType)
    marks = steps.select("code", "date", F.lit(1), F.col("ratio"), none)
    # a step counts for the days before it: bars come first on its own day
    later = (Window.partitionBy("code").orderBy(F.desc("date"), "_side")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    factor = F.lit(1.0) / F.product("_step").over(later)
    out = ones.union(marks).withColumn("_factor", factor).where("_side = 0")
    # the code itself: what follows per symbol needs no exchange
    return out.select(*[
        F.col("code") if c == "code" else
        (F.col(f"_bar.`{c}`") * F.col("_factor") if c in PRICES else F.col(f"_bar.`{c}`")).alias(c)
        for c in bars.columns])


def adjustment_counters(bars: DataFrame) -> DataFrame:
    f = split_flags(bars)
    return f.agg(
        F.count_if("split_candidate").alias("candidates"),
        F.count_if("split_event").alias("events"),
        F.countDistinct(F.when(F.col("split_event"), F.col("code"))).alias("symbols"),
        F.count_if(F.col("split_candidate") & ~F.col("split_event")).alias("skipped_not_split"))


def price_event_flags(bars: DataFrame) -> DataFrame:
    """Adds ``limit_up``, ``limit_down`` and ``extreme_move`` (both days must be live)."""
    w = symbol_window()
    change = (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0) * 100.0
    live = ~F.col("halted") & ~F.coalesce(F.lag("halted").over(w), F.lit(True))
    near = PRICE_LIMIT_PCT - 0.5
    flags = {
        "limit_up": live & (change >= near) & (F.col("close") >= F.col("high") - 1e-9),
        "limit_down": live & (change <= -near) & (F.col("close") <= F.col("low") + 1e-9),
        "extreme_move": live & (F.abs(change) > PRICE_LIMIT_PCT),
    }
    return bars.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
