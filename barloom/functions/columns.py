"""Scalar column functions: price sources, arithmetic with NULL-safe division, text parsing."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Must equal the published data formats for right results.
# Money unit "eok" = 100 million won.
EOK = 100_000_000.0

# Account spellings (whitespace removed) -> filing column.
ACCOUNT_EXACT = {
    "유동자산": "cur_assets",
    "유동부채": "cur_liab",
    "자산총계": "assets",
    "부채총계": "liab",
    "자본총계": "equity",
    "매출액": "revenue",
    "수익(매출액)": "revenue",
    "영업수익": "revenue",
    "영업이익": "op_income",
    "영업이익(손실)": "op_income",
    "당기순이익": "net_income",
    "당기순이익(손실)": "net_income",
}

# Account prefixes accepted when no exact spelling matches.
ACCOUNT_PREFIX = {"영업이익": "op_income", "당기순이익": "net_income", "매출액": "revenue"}

# Amount texts that mean "no amount", and the negative signs used in filings.
EMPTY_AMOUNTS = ["", "-", "--", "N/A", "NaN", "nan", "None"]
NEGATIVE_SIGNS = "△▲−-"

# Bar fields that are price sources as they are.
BAR_FIELDS = ("open", "high", "low", "close", "volume", "amount", "marcap")

# Fixed value: a denominator below this share of total assets gives no ratio.
MIN_DENOM_RATIO = 0.0001

# Days after the quarter end until a report is due (quarterly / annual).
DISCLOSURE_LAG_DAYS = 45
ANNUAL_DISCLOSURE_LAG_DAYS = 90


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def symbol_window(*, code: str = "code", date: str = "date") -> WindowSpec:
    """The one window spec all per-symbol operators share (one exchange, one sort)."""
    return Window.partitionBy(code).orderBy(date)


def pad_code(c: Column | str) -> Column:
    """Zero-fill a symbol to six characters; longer codes stay whole."""
    s = F.trim(_col(c).cast("string"))
    return F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)


def code_variants(code: str) -> list[str]:
    """Every spelling of ``code`` with fewer leading zeros, for pushdown into old files."""
    full = str(code).strip().zfill(6)
    zeros = len(full) - len(full.lstrip("0"))
    return [full[i:] for i in range(min(zeros, len(full) - 1) + 1)]


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, so NULL is the only "unknown" downstream."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def source(name: str) -> Column:
    """Named price source: a bar field or a derived typical price."""
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    derived = {
        "hl2": (h + l) / 2,
        "hlc3": (h + l + c) / 3,
        "typical": (h + l + c) / 3,
        "ohlc4": (o + h + l + c) / 4,
    }
    key = name.lower()
    if key in derived:
        return derived[key]
    if key not in BAR_FIELDS:
        raise ValueError(f"unknown source: {name}")
    return F.col(key)


def prev(c: Column | str, w: WindowSpec | None = None, n: int = 1) -> Column:
    """Value of the previous bar of the symbol."""
    return F.lag(_col(c), n).over(w if w is not None else symbol_window())


def divide(a: Column, b: Column) -> Column:
    """``a / b`` with NULL for division by zero."""
    return F.try_divide(a, b)


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("double")


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NULL for divisor zero."""
    return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))


def power(a: Column, b: Column) -> Column:
    return finite(F.pow(a, b))


def normalize_account(name: Column | str) -> Column:
    """Account name text -> filing column name, or NULL when it is none of ours."""
    s = F.regexp_replace(_col(name), r"\s+", "")
    exact = F.create_map(*[F.lit(x) for kv in ACCOUNT_EXACT.items() for x in kv])
    out = F.try_element_at(exact, s)
    for prefix, target in ACCOUNT_PREFIX.items():
        out = F.coalesce(out, F.when(s.startswith(prefix), F.lit(target)))
    return F.when(s.isNotNull(), out)


def parse_amount(text: Column | str) -> Column:
    """Filing amount text -> BIGINT won. Brackets and triangle signs are negative."""
    s = F.regexp_replace(F.trim(_col(text).cast("string")), "[, \u00a0]", "")
    bracketed = s.rlike(r"^\(.*\)$")
    inner = F.when(bracketed, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    signed = inner.rlike(f"^[{NEGATIVE_SIGNS}]")
    body = F.regexp_replace(inner, f"^[{NEGATIVE_SIGNS}]+", "")
    number = F.bround(F.when(body.rlike(r"^[+]?\d*\.?\d+([eE][+-]?\d+)?$|^[+]?\d+\.$"), body)
                      .try_cast("decimal(38,4)"), 0).try_cast("bigint")
    return F.when(s.isin(EMPTY_AMOUNTS), F.lit(None).cast("bigint")).when(
        bracketed | signed, -number).otherwise(number)


def receipt_date(number: Column | str) -> Column:
    """First eight digits of a receipt number as a date; NULL when they are no date."""
    digits = F.regexp_replace(_col(number).cast("string"), r"\D", "")
    ymd = F.substring(digits, 1, 8)
    return F.when(F.length(ymd) == 8, F.try_to_date(ymd, "yyyyMMdd"))


def capital_impaired(equity: Column | str) -> Column:
    return _col(equity) <= 0


def ratio_reason(numer: Column | str, denom: Column | str, scale: Column | str) -> Column:
    """Why a guarded ratio has (or lacks) a value: ok, missing, nonpositive or tiny."""
    n, d, s = _col(numer), _col(denom), _col(scale)
    return (F.when(n.isNull() | d.isNull(), F.lit("missing"))
            .when(d <= 0, F.lit("nonpositive"))
            .when((s > 0) & (d < s * F.lit(MIN_DENOM_RATIO)), F.lit("tiny"))
            .otherwise(F.lit("ok")))


def guarded_ratio(numer: Column | str, denom: Column | str, scale: Column | str) -> Column:
    """Percentage rounded to two digits, only where the denominator is meaningful."""
    n, d = _col(numer).cast("double"), _col(denom).cast("double")
    return F.when(ratio_reason(numer, denom, scale) == "ok",
                  F.round(F.try_divide(n, d) * 100.0, 2))


def quarter_end(year: Column | str, quarter: Column | str) -> Column:
    y, q = _col(year).cast("int"), _col(quarter).cast("int")
    return F.last_day(F.make_date(y, q * 3, F.lit(1)))


def disclosure_due_date(year: Column | str, quarter: Column | str,
                        lag_days: int = DISCLOSURE_LAG_DAYS,
                        annual_lag_days: int = ANNUAL_DISCLOSURE_LAG_DAYS) -> Column:
    lag = F.when(_col(quarter) == 4, F.lit(annual_lag_days)).otherwise(F.lit(lag_days))
    return F.date_add(quarter_end(year, quarter), lag)


def yyyymmdd(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyyMMdd").cast("int")


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    """Banker's rounding, NULL for non-finite input."""
    return F.bround(finite(c), digits)


def buy_price(price: Column | str, slippage: float) -> Column:
    return _col(price) * F.lit(1.0 + slippage)


def sell_price(price: Column | str, slippage: float) -> Column:
    return _col(price) * F.lit(1.0 - slippage)


def sale_proceeds(price: Column | str, qty: Column | str, slippage: float, fee: float) -> Column:
    return sell_price(price, slippage) * _col(qty) * F.lit(1.0 - fee)


def entry_quantity(notional: Column | float, size_pct: float, price: Column | str) -> Column:
    """Whole shares bought with ``size_pct`` percent of a notional."""
    base = notional if isinstance(notional, Column) else F.lit(float(notional))
    return F.coalesce(F.floor(F.try_divide(base * F.lit(size_pct / 100.0), _col(price))),
                      F.lit(0)).cast("bigint")


def exit_quantity(held: Column | str, size_pct: float) -> Column:
    h = _col(held)
    if size_pct >= 100.0:
        return h.cast("bigint")
    return F.least(h, F.floor(h * F.lit(size_pct / 100.0))).cast("bigint")


def planned_notional(sizing: str, *, equity: float = 0.0, max_positions: int = 1,
                     amount: float = 0.0) -> float:
    """Notional of one position; equity is the initial capital (no shared cash state)."""
    if sizing == "fixed_amount":
        return float(amount)
    if sizing == "fixed_qty":
        return 0.0
    return float(equity) / max(int(max_positions), 1)
