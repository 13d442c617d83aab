"""Registered queries: technical indicators and series (group F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.indicators import halted_free, output_columns, with_indicators
from ..operators import adjust as A
from ..sources import bars as S
from . import base
from .base import query, rounded
from .scans import FACTOR_SQL


def _indicators(spark, sf, wanted: dict, digits: int = 5):
    out = with_indicators(base.bars(spark, sf), wanted, digits)
    return out.select("code", "date", *[c for a, (n, _) in wanted.items() for c in output_columns(a, n)])


_W = "WINDOW w AS (PARTITION BY code ORDER BY date)"
_W20 = _W + """,
  f20 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@query("f1_sma", f"""WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date,
       CASE WHEN count(close) OVER f20 = 20 THEN round(avg(close) OVER f20, 6) END AS ma20,
       CASE WHEN count(*) OVER f5 = 5 THEN round(avg(volume) OVER f5, 6) END AS vol5
FROM bars {_W20},
  f5 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def f1(spark, sf):
    return _indicators(spark, sf, {"ma20": ("SMA", {}),
                                   "vol5": ("SMA", {"period": 5, "source": "volume"})}, 6)


_WMA_TERMS = " + ".join(f"{10 - k} * lag(close, {k}) OVER w" for k in range(10))


@query("f3_wma", f"""WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date, round(({_WMA_TERMS}) / 55, 5) AS wma10
FROM bars {_W}""")
def f3(spark, sf):
    return _indicators(spark, sf, {"wma10": ("WMA", {"period": 10})})


@query("f4_bbands", f"""WITH $bars, x AS (
  SELECT code, date, count(*) OVER f20 AS n, avg(close) OVER f20 AS m, stddev_pop(close) OVER f20 AS s
  FROM bars {_W20})
SELECT code, CAST(date AS VARCHAR) AS date,
       CASE WHEN n = 20 THEN round(m, 6) END AS bb_middle,
       CASE WHEN n = 20 THEN round(m + 2 * s, 5) END AS bb_upper,
       CASE WHEN n = 20 THEN round(m - 2 * s, 5) END AS bb_lower,
       CASE WHEN n = 20 THEN round(4 * s, 5) END AS bb_width FROM x""")
def f4(spark, sf):
    out = with_indicators(base.bars(spark, sf), {"bb": ("BBANDS", {})})
    out = out.select("code", "date", *output_columns("bb", "BBANDS"))
    return rounded(rounded(out, 6, "bb_middle"), 5, "bb_upper", "bb_lower", "bb_width")


def _ewm_sql(column: str, alpha: float, partition: str = "code", order: str = "date") -> str:
    """Recursive mean as a list fold over the earlier values of the symbol."""
    return (f"list_reduce(list({column}) OVER (PARTITION BY {partition} ORDER BY {order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"lambda a, x: a * (1 - {alpha!r}::DOUBLE) + x * {alpha!r}::DOUBLE)")


@query("f2_ema", f"""WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date,
       CASE WHEN row_number() OVER w >= 20 THEN round({_ewm_sql('close', 2 / 21)}, 5) END AS ema20
FROM bars {_W}""")
def f2(spark, sf):
    return _indicators(spark, sf, {"ema20": ("EMA", {})})


@query("f5_rsi", f"""WITH $bars, d AS (
  SELECT code, date, close - lag(close) OVER w AS d, row_number() OVER w AS rn FROM bars {_W}),
e AS (SELECT code, date, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM d WHERE d IS NOT NULL),
m AS (SELECT code, date, row_number() OVER w AS n, {_ewm_sql('up', 1 / 14)} AS mu,
             {_ewm_sql('dn', 1 / 14)} AS md FROM e {_W})
SELECT d.code, CAST(d.date AS VARCHAR) AS date,
       CASE WHEN n >= 14 THEN CASE WHEN md = 0 THEN 100
            ELSE round(100 - 100 / (1 + mu / md), 5) END END AS rsi14
FROM d LEFT JOIN m ON d.code = m.code AND d.date = m.date""")
def f5(spark, sf):
    return _indicators(spark, sf, {"rsi14": ("RSI", {})})


@query("f6_macd", f"""WITH $bars, e AS (
  SELECT code, date, row_number() OVER w AS rn, {_ewm_sql('close', 2 / 13)} AS ef,
         {_ewm_sql('close', 2 / 27)} AS es FROM bars {_W}),
m AS (SELECT code, date, rn, CASE WHEN rn >= 26 THEN ef - es END AS macd FROM e),
s AS (SELECT code, date, macd, CASE WHEN rn >= 34
             THEN {_ewm_sql('macd', 2 / 10, 'code, rn >= 26')} END AS signal FROM m)
SELECT code, CAST(date AS VARCHAR) AS date, round(macd, 5) AS macd_macd,
       round(signal, 5) AS macd_signal, round(macd - signal, 5) AS macd_hist FROM s""")
def f6(spark, sf):
    return _indicators(spark, sf, {"macd": ("MACD", {})})


@query("f7_stoch", f"""WITH $bars, r AS (
  SELECT code, date, CASE WHEN count(*) OVER f = 14 THEN
         100 * (close - min(low) OVER f) / nullif(max(high) OVER f - min(low) OVER f, 0) END AS raw
  FROM bars WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, CASE WHEN count(raw) OVER f = 3 THEN avg(raw) OVER f END AS k FROM r
      WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT code, CAST(date AS VARCHAR) AS date, round(raw, 5) AS st_raw, round(k, 5) AS st_k,
       round(CASE WHEN count(k) OVER f = 3 THEN avg(k) OVER f END, 5) AS st_d FROM k
WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def f7(spark, sf):
    return _indicators(spark, sf, {"st": ("STOCH", {})})


_TR_SQL = f"""tr AS (
  SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph,
         lag(low) OVER w AS pl,
         greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM bars {_W})"""


@query("f9_atr", f"""WITH $bars, {_TR_SQL}
SELECT code, CAST(date AS VARCHAR) AS date, round(tr, 5) AS true_range,
       CASE WHEN rn >= 14 THEN round({_ewm_sql('tr', 1 / 14)}, 5) END AS atr14 FROM tr""")
def f9(spark, sf):
    from ..functions.indicators import true_range

    b = base.bars(spark, sf).withColumn("true_range", true_range())
    out = with_indicators(b, {"atr14": ("ATR", {})})
    return rounded(out.select("code", "date", "true_range", "atr14"), 5, "true_range", "atr14")


@query("f10_adx", f"""WITH $bars, {_TR_SQL},
dm AS (SELECT code, date, rn, {_ewm_sql('tr', 1 / 14)} AS atr,
              CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
              CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM tr),
sm AS (SELECT code, date, rn, atr, {_ewm_sql('pdm', 1 / 14, 'code, rn > 1')} AS p,
              {_ewm_sql('mdm', 1 / 14, 'code, rn > 1')} AS m FROM dm),
di AS (SELECT code, date, rn, CASE WHEN rn >= 15 THEN 100 * p / nullif(atr, 0) END AS pdi,
              CASE WHEN rn >= 15 THEN 100 * m / nullif(atr, 0) END AS mdi FROM sm),
ax AS (SELECT code, date, rn, pdi, mdi, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di)
SELECT code, CAST(date AS VARCHAR) AS date, round(pdi, 5) AS a_pdi, round(mdi, 5) AS a_mdi,
       CASE WHEN rn >= 28 THEN round({_ewm_sql('dx', 1 / 14, 'code, rn >= 15')}, 5) END AS a_adx
FROM ax""")
def f10(spark, sf):
    return _indicators(spark, sf, {"a": ("ADX", {})})


@query("f11_cci", f"""WITH $bars, t AS (SELECT code, date, (high + low + close) / 3 AS tp FROM bars),
g AS (SELECT code, date, tp, list(tp) OVER f20 AS ls, avg(tp) OVER f20 AS m FROM t {_W20})
SELECT code, CAST(date AS VARCHAR) AS date, CASE WHEN len(ls) = 20 THEN round((tp - m)
       / nullif(0.015::DOUBLE * list_avg(list_transform(ls, lambda v: abs(v - m))), 0), 5) END AS cci20
FROM g""")
def f11(spark, sf):
    return _indicators(spark, sf, {"cci20": ("CCI", {})})


@query("f12_obv", f"""WITH $bars, s AS (
  SELECT code, date, coalesce(sign(close - lag(close) OVER w) * volume, 0) AS step FROM bars {_W})
SELECT code, CAST(date AS VARCHAR) AS date, sum(step) OVER w AS obv FROM s {_W}""")
def f12(spark, sf):
    return _indicators(spark, sf, {"obv": ("OBV", {})}, 2)


_VWAP = "sum((high + low + close) / 3 * volume) OVER {w} / nullif(sum(volume) OVER {w}, 0)"


def _vwap_gap(w: str) -> str:
    return f"round((close / ({_VWAP.format(w=w)}) - 1) * 100, 6) + 0"


@query("f13_vwap", f"""WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date, {_vwap_gap('w')} AS gap_all,
       {_vwap_gap('m')} AS gap_month, {_vwap_gap('k')} AS gap_week
FROM bars {_W}, m AS (PARTITION BY code, date_trunc('month', date) ORDER BY date),
  k AS (PARTITION BY code, date_trunc('week', date) ORDER BY date)""")
def f13(spark, sf):
    """Distance of the close from its volume-weighted price, percent, for three anchors."""
    out = with_indicators(base.bars(spark, sf), {
        "all": ("VWAP", {}), "month": ("VWAP", {"anchor": "month"}),
        "week": ("VWAP", {"anchor": "week"})})
    return out.select("code", "date", *[
        F.round((F.try_divide(F.col("close"), F.col(a)) - 1) * 100, 6).alias(f"gap_{a}")
        for a in ("all", "month", "week")])


@query("f14_envelope", f"""WITH $bars, x AS (
  SELECT code, date, CASE WHEN count(*) OVER f20 = 20 THEN avg(close) OVER f20 END AS m FROM bars {_W20})
SELECT code, CAST(date AS VARCHAR) AS date, round(m * (1 + 5 / 100::DOUBLE), 6) AS env_upper,
       round(m, 6) AS env_middle, round(m * (1 - 5 / 100::DOUBLE), 6) AS env_lower FROM x""")
def f14(spark, sf):
    return _indicators(spark, sf, {"env": ("ENVELOPE", {})}, 6)


_W60 = "(PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query("f15_channels", f"""WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date,
       CASE WHEN count(*) OVER f60 = 60 THEN max(close) OVER f60 END AS hi60,
       CASE WHEN count(*) OVER f60 = 60 THEN min(close) OVER f60 END AS lo60,
       CASE WHEN count(*) OVER f20 = 20 THEN round(max(high) OVER f20, 5) END AS dc_upper,
       CASE WHEN count(*) OVER f20 = 20 THEN round(min(low) OVER f20, 5) END AS dc_lower,
       CASE WHEN count(*) OVER f20 = 20
            THEN round((max(high) OVER f20 + min(low) OVER f20) / 2, 6) END AS dc_middle
FROM bars {_W20}, f60 AS {_W60}""")
def f15(spark, sf):
    wanted = {"hi60": ("HIGHEST", {"period": 60}), "lo60": ("LOWEST", {"period": 60}),
              "dc": ("DONCHIAN", {})}
    cols = [c for a, (n, _) in wanted.items() for c in output_columns(a, n)]
    out = with_indicators(base.bars(spark, sf), wanted).select("code", "date", *cols)
    return rounded(rounded(out, 5, "dc_upper", "dc_lower"), 6, "dc_middle")


@query("f18_adjusted_prices", f"""WITH $raw_bars, {FACTOR_SQL}
SELECT code, CAST(date AS VARCHAR) AS date, factor, round(open * factor, 6) AS open,
       round(high * factor, 6) AS high, round(low * factor, 6) AS low,
       round(close * factor, 6) AS close, volume FROM fa""")
def f18(spark, sf):
    out = A.adjust_prices(base.raw_bars(spark, sf), keep_flags=True)
    return rounded(out.select("code", "date", "factor", "open", "high", "low", "close", "volume"),
                   6, "open", "high", "low", "close")


@query("f19_adjustment_counters", f"""WITH $raw_bars, {FACTOR_SQL}
SELECT CAST(count(*) FILTER (WHERE cand) AS BIGINT) AS candidates,
       CAST(count(*) FILTER (WHERE split) AS BIGINT) AS events,
       count(DISTINCT CASE WHEN split THEN code END) AS symbols,
       CAST(count(*) FILTER (WHERE cand AND NOT split) AS BIGINT) AS skipped_not_split FROM fa""")
def f19(spark, sf):
    return A.adjustment_counters(base.raw_bars(spark, sf))


@query("f20_price_limits", f"""WITH $raw_bars, x AS (
  SELECT *, (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS chg,
         NOT halted AND NOT coalesce(lag(halted) OVER w, true) AS live FROM raw_bars {_W})
SELECT code, CAST(count(*) FILTER (WHERE live AND chg >= 29.5 AND close >= high - 1e-9) AS BIGINT) AS limit_up,
       CAST(count(*) FILTER (WHERE live AND chg <= -29.5 AND close <= low + 1e-9) AS BIGINT) AS limit_down,
       CAST(count(*) FILTER (WHERE live AND abs(chg) > 30) AS BIGINT) AS extreme_moves
FROM x GROUP BY code""")
def f20(spark, sf):
    f = A.price_event_flags(base.raw_bars(spark, sf))
    return f.groupBy("code").agg(F.count_if("limit_up").alias("limit_up"),
                                 F.count_if("limit_down").alias("limit_down"),
                                 F.count_if("extreme_move").alias("extreme_moves"))


@query("f26_halted_free", """WITH $raw_bars
SELECT code, CAST(date AS VARCHAR) AS date, volume,
       CASE WHEN NOT halted AND count(*) OVER f = 20 THEN round(avg(volume) OVER f, 6) END AS v20
FROM raw_bars WINDOW f AS (PARTITION BY code, halted ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def f26(spark, sf):
    out = halted_free(base.raw_bars(spark, sf), {"v20": ("SMA", {"source": "volume"})})
    return rounded(out.select("code", "date", "volume", "v20"), 6, "v20")


@query("f27_warmup_range", f"""WITH $bars, x AS (
  SELECT code, date, CASE WHEN count(*) OVER f20 = 20 THEN round(avg(close) OVER f20, 6) END AS ma20
  FROM bars {_W20})
SELECT code, CAST(date AS VARCHAR) AS date, ma20 FROM x
WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'""")
def f27(spark, sf):
    """The visible range is cut after the indicator, so its first bar already has a value."""
    out = with_indicators(base.bars(spark, sf), {"ma20": ("SMA", {})})
    return rounded(S.panel(out.withColumn("halted", F.lit(False)), "1999-01-01", "1999-06-30",
                           ["ma20"]).drop("halted"), 6, "ma20")


ALL_INDICATORS = {"sma": ("SMA", {}), "ema": ("EMA", {}), "wma": ("WMA", {}),
                  "bb": ("BBANDS", {}), "rsi": ("RSI", {}), "macd": ("MACD", {}),
                  "st": ("STOCH", {}), "atr": ("ATR", {}), "adx": ("ADX", {}),
                  "cci": ("CCI", {}), "obv": ("OBV", {}), "vwap": ("VWAP", {}),
                  "env": ("ENVELOPE", {}), "hi": ("HIGHEST", {"period": 60}),
                  "lo": ("LOWEST", {"period": 60}), "dc": ("DONCHIAN", {})}


@query("f0_all_indicators")
def f_all(spark, sf):
    """All sixteen indicators in one plan (rows checked here, values by the single queries)."""
    return _indicators(spark, sf, ALL_INDICATORS)
