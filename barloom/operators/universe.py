"""Which symbols are eligible, and the fundamentals filter of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.columns import EOK
from ..sources.bars import latest_rows
from .asof import STREAK_LIMIT, as_of, consecutive_profit_quarters

LABELS = ["name", "market", "market_id", "dept"]


def universe_filter(*, markets: list[str] | None = None, exclude: list[str] | None = None,
                    market_cap_min_eok=None, market_cap_max_eok=None, price_min=None,
                    price_max=None, amount_min_eok=None, volume_min=None):
    """One predicate over a row with label and value columns."""
    tests = []
    if markets:
        tests.append(P.in_markets(markets))
    if exclude:
        tests.append(~P.excluded(exclude))
    for column, op, bound, unit in (
            ("marcap", ">=", market_cap_min_eok, EOK), ("marcap", "<=", market_cap_max_eok, EOK),
            ("close", ">=", price_min, 1.0), ("close", "<=", price_max, 1.0),
            ("amount", ">=", amount_min_eok, EOK), ("volume", ">=", volume_min, 1.0)):
        if bound is not None:
            tests.append(P.compare(F.col(column), op, bound * unit))
    return P.all_of(*tests)


def eligible_symbols(bars: DataFrame, **filters) -> DataFrame:
    """Codes whose newest row in the range passes the filters.

    The newest row comes from a hash aggregation of the needed columns (``max_by`` per
    column), not from a window over the whole history.
    """
    columns = [c for c in [*LABELS, "close", "amount", "volume", "marcap"] if c in bars.columns]
    return latest_rows(bars, columns).where(universe_filter(**filters)).select("code")


def judge_events(events: DataFrame, filings: DataFrame, *, debt_ratio_max=None,
                 current_ratio_min=None, profitable_quarters_min=None) -> DataFrame:
    """Adds ``verdict`` to every event from the filings known on the event's own date."""
    out = as_of(events, filings, columns=["debt_ratio_pct", "current_ratio_pct",
                                          "capital_impaired"], prefix="f_")
    if profitable_quarters_min is not None:
        streak = consecutive_profit_quarters(
            out, filings, limit=max(STREAK_LIMIT, profitable_quarters_min))
    else:
        streak = out.withColumn("profit_quarters", F.lit(None).cast("int"))
    verdict = P.fundamentals_verdict(
        has_filing=F.col("f_year").isNotNull(), debt_ratio_max=debt_ratio_max,
        current_ratio_min=current_ratio_min, profitable_quarters_min=profitable_quarters_min,
        debt_ratio="f_debt_ratio_pct", current_ratio="f_current_ratio_pct")
    return streak.withColumn("verdict", verdict)


def filter_events(events: DataFrame, filings: DataFrame, on_missing: str = "include",
                  drop_impaired: bool = False, **filters) -> DataFrame:
    judged = judge_events(events, filings, **filters).where(P.keep_verdict("verdict", on_missing))
    if drop_impaired:
        judged = judged.where(P.not_impaired("f_capital_impaired", on_missing))
    return judged.select(*events.columns)


def missing_financials(judged: DataFrame) -> DataFrame:
    """Distinct codes with an unknown verdict and their share of all judged codes."""
    missing = F.countDistinct(F.when(F.col("verdict") == "unknown", F.col("code")))
    total = F.countDistinct("code")
    return judged.agg(missing.alias("missing_financials"),
                      F.coalesce(F.round(F.try_divide(missing, total) * 100.0, 2), F.lit(0.0))
                      .alias("missing_financials_pct"))
