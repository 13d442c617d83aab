"""Performance of a run: trade statistics, equity, drawdown, returns, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matching import position_fills

# Trading days a year and the yearly risk-free rate of the Sharpe ratio.
TRADING_DAYS = 252
RISK_FREE_RATE = 0.03


def trade_stats(trades: DataFrame) -> DataFrame:
    """Counts, win rate, profit factor and averages over exit events, in one aggregation."""
    pnl, ret = F.col("pnl"), F.col("return_pct")
    win, loss = pnl > 0, pnl < 0
    gain = F.coalesce(F.sum(F.when(win, pnl)), F.lit(0.0))
    cost = -F.coalesce(F.sum(F.when(loss, pnl)), F.lit(0.0))
    return trades.agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(win).alias("wins"),
        F.count_if(loss).alias("losses"),
        F.coalesce(F.try_divide(F.count_if(win) * 100.0, F.count(F.lit(1))), F.lit(0.0))
        .alias("win_rate_pct"),
        F.when(cost > 0, gain / cost).when(gain > 0, F.lit(None)).otherwise(0.0)
        .alias("profit_factor"),
        F.coalesce(F.avg(F.when(win, ret)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(loss, ret)), F.lit(0.0)).alias("avg_loss_pct"),
        F.coalesce(F.avg("hold_days"), F.lit(0.0)).alias("avg_hold_days"),
        gain.alias("gross_profit"), cost.alias("gross_loss"))


def by_stock(trades: DataFrame) -> DataFrame:
    """Trades, win rate and profit per symbol; order with ``orderBy(desc('pnl'))``."""
    n = F.count(F.lit(1))
    return trades.groupBy("code").agg(
        n.alias("trades"), (F.count_if(F.col("pnl") > 0) * 100.0 / n).alias("win_rate"),
        F.sum("pnl").alias("pnl"))


def daily_equity(ledger: DataFrame, bars: DataFrame, cal: DataFrame, *, initial: float,
                 fee: float) -> DataFrame:
    """Mark-to-market equity: cash flows summed up plus open quantity at the carried close.

    A sweep: the market value of a symbol only changes with its quantity or its close, so every
    held bar and every flow adds the change of quantity x close to its day, and one running sum
    over the trading days (one row each) adds them up.  Only bars inside holding periods are
    moved; days without a bar need no row, as nothing changes on them.
    """
    buys = position_fills(ledger).select(
        "code", F.col("f.date").alias("date"), F.col("f.qty").alias("dq"),
        (-F.col("f.qty") * F.col("f.price")).alias("cash"))
    sells = ledger.select(
        "code", F.col("exit_date").alias("date"), (-F.col("qty")).alias("dq"),
        (F.col("exit_price") * F.col("qty") * (1.0 - fee)).alias("cash"))
    periods = ledger.groupBy(F.col("code").alias("held_code"), "group_id").agg(
        F.min("entry_date").alias("held_from"), F.max("exit_date").alias("held_to"))
    marks = bars.join(periods, (F.col("code") == F.col("held_code"))
                      & F.col("date").between(F.col("held_from"), F.col("held_to")), "left_semi")
    none = F.lit(None)
    events = (buys.unionByName(sells).withColumn("close", none.cast("double")).unionByName(
        marks.select("code", "date", none.cast("bigint").alias("dq"),
                     none.cast("double").alias("cash"), "close")))
    # both aggregation and window use the exchange on the symbol
    days = events.repartition("code").groupBy("code", "date").agg(
        F.sum(F.coalesce("dq", F.lit(0))).alias("dq"), F.sum("cash").alias("cash"),
        F.max("close").alias("close"))
    in_order = Window.partitionBy("code").orderBy("date")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    worth = F.coalesce(F.sum("dq").over(so_far) * F.last("close", ignorenulls=True).over(so_far),
                       F.lit(0.0))
    days = days.withColumn("worth", worth)
    change = F.col("worth") - F.coalesce(F.lag("worth").over(in_order), F.lit(0.0))
    per_day = days.select("date", "cash", change.alias("change")).groupBy("date").agg(
        F.sum("change").alias("change"), F.sum("cash").alias("cash"))
    total = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (cal.select("date").join(per_day, "date", "left").select(
        "date", (F.lit(float(initial)) + F.sum(F.coalesce("cash", F.lit(0.0))).over(total)
                 + F.sum(F.coalesce("change", F.lit(0.0))).over(total)).alias("value")))


def drawdown(equity: DataFrame) -> DataFrame:
    """Adds ``drawdown`` percent; runs on one row per trading day."""
    peak = F.max("value").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("drawdown", F.coalesce(
        (F.try_divide(F.col("value"), peak) - 1.0) * 100.0, F.lit(0.0)))


def equity_curve(equity: DataFrame, initial: float) -> DataFrame:
    """Equity normalised to 100 with its drawdown."""
    return drawdown(equity).withColumn("value", F.col("value") / initial * 100.0)


def monthly_returns(equity: DataFrame) -> DataFrame:
    """Return of each month; the first one is measured from the first equity value."""
    months = equity.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.max_by("value", "date").alias("last"), F.min_by("value", "date").alias("first"))
    before = F.lag("last").over(Window.orderBy("month"))
    base = F.coalesce(before, F.col("first"))
    return months.select("month", F.coalesce((F.try_divide(F.col("last"), base) - 1.0) * 100.0,
                                             F.lit(0.0)).alias("return_pct"))


def performance(equity: DataFrame, *, initial: float, start=None, end=None) -> DataFrame:
    """Total return, yearly growth, Sharpe ratio and maximum drawdown in one row."""
    w = Window.orderBy("date")
    ret = F.try_divide(F.col("value") - F.lag("value").over(w), F.lag("value").over(w))
    x = drawdown(equity).withColumn("ret", ret)
    sd, n, m = F.stddev_samp("ret"), F.count("ret"), F.avg("ret")
    first = F.lit(start).cast("date") if start else F.min("date")
    last = F.lit(end).cast("date") if end else F.max("date")
    a = x.agg(
        F.max_by("value", "date").alias("final_capital"),
        F.min("drawdown").alias("mdd_pct"), (F.datediff(last, first) / 365.25).alias("years"),
        F.when((F.count(F.lit(1)) >= 3) & (n >= 2) & (sd > 0),
               (m - RISK_FREE_RATE / TRADING_DAYS) / sd * (TRADING_DAYS ** 0.5)).alias("sharpe"))
    growth = F.col("final_capital") / initial
    return a.select(
        ((growth - 1.0) * 100.0).alias("total_return_pct"),
        F.when(F.col("final_capital") <= 0, -100.0)
        .when((F.col("years") > 0) & F.lit(initial > 0),
              (F.pow(growth, 1.0 / F.col("years")) - 1.0) * 100.0).alias("cagr_pct"),
        "sharpe", "mdd_pct", "final_capital", "years")


def quality_counters(bars: DataFrame, ledger: DataFrame) -> DataFrame:
    """Halted bars and symbols, extreme moves, fills at the price limit, same-day round trips."""
    from .adjust import price_event_flags

    flagged = price_event_flags(bars)
    market = flagged.agg(
        F.count_if("halted").alias("halted_bars"),
        F.countDistinct(F.when(F.col("halted"), F.col("code"))).alias("halted_symbols"),
        F.count_if("extreme_move").alias("extreme_moves"))
    entries = position_fills(ledger).select("code", F.col("f.date").alias("date"))
    up = flagged.where("limit_up").select("code", "date")
    down = flagged.where("limit_down").select("code", "date")
    sold = ledger.where("exit_rule != 'EOD'").select("code", F.col("exit_date").alias("date"))
    limit = (entries.join(up, ["code", "date"], "left_semi")
             .unionByName(sold.join(down, ["code", "date"], "left_semi"))
             .agg(F.count(F.lit(1)).alias("limit_price_fills")))
    same = F.count_if(F.col("entry_date") == F.col("exit_date"))
    trips = ledger.agg(same.alias("same_day_trips"), F.coalesce(F.round(F.try_divide(
        same * 100.0, F.count(F.lit(1))), 2), F.lit(0.0)).alias("same_day_pct"))
    # three one-row tables side by side
    return market.crossJoin(limit).crossJoin(trips)
