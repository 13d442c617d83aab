"""Two-valued predicates over bars and universe / fundamentals filters.

Comparisons with an unknown side are False, also under NOT, so every leaf is coalesced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .columns import symbol_window

# Names under which each market appears in the data.
MARKET_ALIASES = {
    "KOSPI": ["KOSPI", "STK", "유가증권", "유가증권시장"],
    "KOSDAQ": ["KOSDAQ", "KSQ", "코스닥", "코스닥시장"],
    "KONEX": ["KONEX", "KNX", "코넥스"],
}

# Patterns that mark special symbols.
PREFERRED_NAME = "우(?:B|C)?$"
SPAC_NAME = "스팩|기업인수목적"
ETF_NAME = "KODEX|TIGER|KBSTAR|ARIRANG|KINDEX|HANARO|SOL |ACE |PLUS |RISE "
REIT_NAME = "리츠"
ADMIN_DEPT = "관리"
HALT_DEPT = "정지"

_COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def known(p: Column) -> Column:
    """Unknown counts as False."""
    return F.coalesce(p, F.lit(False))


def compare(a, op: str, b) -> Column:
    return known(_COMPARE[op](_lit(a), _lit(b)))


def all_of(*predicates: Column) -> Column:
    return reduce(lambda p, q: p & q, map(known, predicates), F.lit(True))


def any_of(*predicates: Column) -> Column:
    if not predicates:
        return F.lit(True)
    return reduce(lambda p, q: p | q, map(known, predicates))


def negate(p: Column) -> Column:
    return ~known(p)


def cross_above(a, b, w: WindowSpec | None = None) -> Column:
    w = w if w is not None else symbol_window()
    a, b = _lit(a), _lit(b)
    return known((a > b) & (F.lag(a).over(w) <= F.lag(b).over(w)))


def cross_below(a, b, w: WindowSpec | None = None) -> Column:
    w = w if w is not None else symbol_window()
    a, b = _lit(a), _lit(b)
    return known((a < b) & (F.lag(a).over(w) >= F.lag(b).over(w)))


def in_markets(markets: list[str], market: str = "market", market_id: str = "market_id") -> Column:
    names = sorted({alias for m in markets for alias in MARKET_ALIASES.get(m.upper(), [m.upper()])})
    clean = [F.upper(F.trim(F.col(c))) for c in (market, market_id)]
    return any_of(*[c.isin(names) for c in clean])


def excluded(kinds: list[str]) -> Column:
    """True for symbols of any of the listed special kinds."""
    code, name, dept = (F.coalesce(F.col(c), F.lit("")) for c in ("code", "name", "dept"))
    rules = {
        "PREFERRED": (F.substring(code, -1, 1) != "0") | name.rlike(PREFERRED_NAME),
        "SPAC": name.rlike(SPAC_NAME),
        "ETF": dept.contains("ETF") | name.rlike(ETF_NAME),
        "ETN": dept.contains("ETN") | name.contains("ETN"),
        "REIT": name.contains(REIT_NAME),
        "ADMIN_ISSUE": dept.contains(ADMIN_DEPT),
        "TRADE_HALT": dept.contains(HALT_DEPT),
    }
    picked = [rules[k.upper()] for k in kinds]
    return any_of(*picked) if picked else F.lit(False)


def fundamentals_verdict(*, has_filing: Column, debt_ratio_max: float | None = None,
                         current_ratio_min: float | None = None,
                         profitable_quarters_min: int | None = None,
                         debt_ratio: str = "debt_ratio_pct",
                         current_ratio: str = "current_ratio_pct",
                         streak: str = "profit_quarters") -> Column:
    """'pass', 'fail' or 'unknown'; a known failure beats an unknown value."""
    checks = []
    if debt_ratio_max is not None:
        checks.append(F.col(debt_ratio) < debt_ratio_max)
    if current_ratio_min is not None:
        checks.append(F.col(current_ratio) > current_ratio_min)
    if profitable_quarters_min is not None:
        checks.append(F.col(streak) >= profitable_quarters_min)
    failed = reduce(lambda p, q: p | q, [known(~c) for c in checks], F.lit(False))
    unknown = reduce(lambda p, q: p | q, [c.isNull() for c in checks], ~has_filing)
    return (F.when(failed, F.lit("fail")).when(unknown, F.lit("unknown"))
            .otherwise(F.lit("pass")))


def keep_verdict(verdict: Column | str, on_missing: str = "include") -> Column:
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    allowed = ["pass", "unknown"] if on_missing == "include" else ["pass"]
    return v.isin(allowed)


def not_impaired(impaired: Column | str = "capital_impaired", on_missing: str = "include") -> Column:
    """Known-impaired companies are always dropped; unknown ones follow ``on_missing``."""
    c = F.col(impaired) if isinstance(impaired, str) else impaired
    return ~F.coalesce(c, F.lit(False)) if on_missing == "include" else F.coalesce(~c, F.lit(False))


def reference_gate(condition: str | None, *, ref: str = "ref", pullback_pct: float | None = None,
                   probe: str = "touch") -> Column:
    """Entry gate against the carried reference bar (a struct column)."""
    price = F.col("low") if probe == "touch" else F.col("close")
    if condition == "close_below_reference_open":
        return known(price <= F.col(f"{ref}.open"))
    if condition == "close_below_reference_low":
        return known(price <= F.col(f"{ref}.low"))
    if condition == "pullback_pct" and pullback_pct is not None:
        return known(price <= F.col(f"{ref}.close") * (1.0 + pullback_pct / 100.0))
    return F.lit(True)


def reference_valid(day_idx: str = "day_idx", ref_idx: str = "ref.day_idx",
                    valid_days: int = 60) -> Column:
    return F.col(day_idx) - F.col(ref_idx) <= valid_days
