"""Registered queries: universe filters, event scans, joins (groups C, D, J1-J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.columns import prev
from ..functions.indicators import with_indicators
from ..operators import asof as AO
from ..operators import events as E
from ..operators import universe as U
from ..sources import bars as S
from . import base
from .base import query, rounded

_LAST = """last AS (
  SELECT code, arg_max(name, date) AS name, arg_max(market, date) AS market,
         arg_max(market_id, date) AS market_id, arg_max(dept, date) AS dept,
         arg_max(close, date) AS close, arg_max(amount, date) AS amount,
         arg_max(volume, date) AS volume, arg_max(marcap, date) AS marcap
  FROM raw_bars GROUP BY code)"""

_EXCLUDED = """(right(code, 1) <> '0' OR regexp_matches(name, '우(?:B|C)?$')) AS preferred,
         regexp_matches(name, '스팩|기업인수목적') AS spac,
         (contains(dept, 'ETF') OR regexp_matches(name,
            'KODEX|TIGER|KBSTAR|ARIRANG|KINDEX|HANARO|SOL |ACE |PLUS |RISE ')) AS etf,
         (contains(dept, 'ETN') OR contains(name, 'ETN')) AS etn, contains(name, '리츠') AS reit,
         contains(dept, '관리') AS admin_issue, contains(dept, '정지') AS trade_halt"""


@query("c7_markets", f"""WITH $raw_bars, {_LAST}
SELECT code, market FROM last WHERE upper(trim(market)) IN ('KOSPI', 'KOSDAQ')
  OR upper(trim(market_id)) IN ('STK', 'KSQ')""")
def c7(spark, sf):
    last = S.latest_rows(base.raw_bars(spark, sf), ["market", "market_id"])
    return last.where(P.in_markets(["kospi", "KOSDAQ"])).select("code", "market")


_KINDS = ["preferred", "spac", "etf", "etn", "reit", "admin_issue", "trade_halt"]


@query("c8_special_kinds", f"""WITH $raw_bars, {_LAST}, k AS (SELECT code, {_EXCLUDED} FROM last)
SELECT code, {', '.join(f'CAST({k} AS BIGINT) AS {k}' for k in _KINDS)} FROM k""")
def c8(spark, sf):
    last = S.latest_rows(base.raw_bars(spark, sf), ["name", "dept"])
    return last.select("code", *[P.excluded([k]).cast("bigint").alias(k) for k in _KINDS])


@query("c13_eligible_symbols", f"""WITH $raw_bars, {_LAST}, k AS (SELECT *, {_EXCLUDED} FROM last)
SELECT code FROM k WHERE market IN ('KOSPI', 'KONEX') AND NOT (spac OR etf OR etn OR admin_issue)
  AND marcap BETWEEN 5.5e8 AND 2.2e9 AND close BETWEEN 510 AND 1090 AND amount >= 1e4
  AND volume >= 2""")
def c13(spark, sf):
    return U.eligible_symbols(
        base.raw_bars(spark, sf), markets=["KOSPI", "KONEX"],
        exclude=["SPAC", "ETF", "ETN", "ADMIN_ISSUE"], market_cap_min_eok=5.5,
        market_cap_max_eok=22, price_min=510, price_max=1090, amount_min_eok=0.0001, volume_min=2)


# ---------------------------------------------------------------- event scans

_SCAN = "code, CAST(date AS VARCHAR) AS date, amount, round(close, 6) AS close"


def _events(df):
    return rounded(df.select("code", "date", "amount", "close"), 6, "close")


@query("j1_amount_spike", f"""WITH $raw_bars, x AS (
  SELECT *, lag(amount) OVER w AS pa, lag(halted) OVER w AS ph FROM raw_bars
  WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT {_SCAN} FROM x WHERE amount >= 60000 AND pa <= 20000 AND NOT coalesce(ph, true)
  AND NOT halted AND date >= DATE '1996-01-01'""")
def j1(spark, sf):
    return _events(E.scan(base.raw_bars(spark, sf), E.amount_spike(60000.0, 20000.0), "1996-01-01"))


@query("j2_volume_spike", """WITH $bars, x AS (
  SELECT *, avg(volume) OVER f AS ma, count(*) OVER f AS n FROM bars
  WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
h AS (SELECT * FROM x WHERE n = 20 AND volume >= 2 * ma)
SELECT code, count(*) AS spikes, max(volume) AS top_volume, CAST(max(date) AS VARCHAR) AS last_spike
FROM h GROUP BY code""")
def j2(spark, sf):
    """Flagship: bars -> moving average of volume -> spikes -> summary per symbol."""
    b = base.bars(spark, sf).withColumn("halted", F.lit(False))
    hits = E.scan(b, E.volume_spike(20, 2.0), columns=["code", "date", "volume"])
    return hits.groupBy("code").agg(F.count(F.lit(1)).alias("spikes"),
                                    F.max("volume").alias("top_volume"),
                                    F.max("date").alias("last_spike"))


@query("j3_range_breakout", f"""WITH $raw_bars, x AS (
  SELECT *, max(high) OVER f AS hh, count(*) OVER f AS n FROM raw_bars
  WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT {_SCAN} FROM x WHERE n = 20 AND close > hh AND NOT halted""")
def j3(spark, sf):
    return _events(E.scan(base.raw_bars(spark, sf), E.range_breakout(20)))


@query("j4_custom_rule", f"""WITH $raw_bars, m AS (
  SELECT *, CASE WHEN count(*) OVER f = 20 THEN avg(close) OVER f END AS ma20,
         lag(close) OVER (PARTITION BY code ORDER BY date) AS pc FROM raw_bars
  WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, lag(ma20) OVER (PARTITION BY code ORDER BY date) AS pm FROM m)
SELECT {_SCAN} FROM x WHERE close > ma20 AND pc <= pm AND volume >= 40 AND NOT halted""")
def j4(spark, sf):
    """Close crosses its average on high volume; symbols never that busy are dropped first."""
    busy = P.compare(F.col("volume"), ">=", 40)
    b = E.candidate_symbols(base.raw_bars(spark, sf), busy)
    b = with_indicators(b, {"ma20": ("SMA", {})})
    return _events(E.scan(b, P.all_of(P.cross_above(F.col("close"), F.col("ma20")), busy)))


@query("j5_every_live_bar", """WITH $raw_bars
SELECT code, count(*) AS events FROM raw_bars WHERE NOT halted AND date >= DATE '1999-01-01'
GROUP BY code""")
def j5(spark, sf):
    return (E.scan(base.raw_bars(spark, sf), E.every_bar(), "1999-01-01").groupBy("code")
            .agg(F.count(F.lit(1)).alias("events")))


_REF = """b AS (SELECT *, row_number() OVER w AS idx, dense_rank() OVER (ORDER BY date) AS dno,
    volume >= 45 AND NOT halted AS ev FROM raw_bars
  WINDOW w AS (PARTITION BY code ORDER BY date)),
ref AS (SELECT b.*, e.date AS ref_date, e.idx AS ref_idx, e.dno AS ref_dno, e.open AS ref_open, e.low AS ref_low,
        e.close AS ref_close FROM b ASOF JOIN (SELECT * FROM b WHERE ev) e
        ON b.code = e.code AND b.idx > e.idx)"""


@query("c21_reference_gates", f"""WITH $raw_bars, {_REF}
SELECT code, count(*) AS watched, CAST(count(*) FILTER (WHERE low <= ref_open) AS BIGINT) AS below_open,
       CAST(count(*) FILTER (WHERE low <= ref_low) AS BIGINT) AS below_low,
       CAST(count(*) FILTER (WHERE close <= ref_close * 0.97) AS BIGINT) AS pullback
FROM ref WHERE NOT halted AND NOT ev AND dno - ref_dno <= 5 GROUP BY code""")
def c21(spark, sf):
    from ..operators.matching import active_reference, index_bars

    b = E.flag_events(base.raw_bars(spark, sf), P.compare(F.col("volume"), ">=", 45))
    watched = active_reference(index_bars(b), valid_days=5)
    return watched.groupBy("code").agg(
        F.count(F.lit(1)).alias("watched"),
        F.count_if(P.reference_gate("close_below_reference_open")).alias("below_open"),
        F.count_if(P.reference_gate("close_below_reference_low")).alias("below_low"),
        F.count_if(P.reference_gate("pullback_pct", pullback_pct=-3.0, probe="close"))
        .alias("pullback"))


@query("d5_eligible_events", """WITH $raw_bars, last AS (
  SELECT code, arg_max(market, date) AS market FROM raw_bars GROUP BY code)
SELECT r.code, count(*) AS events FROM raw_bars r WHERE NOT halted AND volume >= 45
  AND r.code IN (SELECT code FROM last WHERE market = 'KOSDAQ') GROUP BY r.code""")
def d5(spark, sf):
    b = base.raw_bars(spark, sf)
    ev = E.scan(b, P.compare(F.col("volume"), ">=", 45))
    return (E.only_symbols(ev, U.eligible_symbols(b, markets=["KOSDAQ"])).groupBy("code")
            .agg(F.count(F.lit(1)).alias("events")))


@query("d6_candidate_symbols", """WITH $bars
SELECT code, count(*) AS bars FROM bars
WHERE code IN (SELECT code FROM bars WHERE volume >= 90) GROUP BY code""")
def d6(spark, sf):
    return (E.candidate_symbols(base.bars(spark, sf), F.col("volume") >= 90).groupBy("code")
            .agg(F.count(F.lit(1)).alias("bars")))


@query("d7_calendar_index", """WITH $bars, cal AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_idx FROM (SELECT DISTINCT date FROM bars))
SELECT code, CAST(date AS VARCHAR) AS date, day_idx FROM bars JOIN cal USING (date)""")
def d7(spark, sf):
    return S.with_day_index(base.bars(spark, sf)).select("code", "date", "day_idx")


@query("d8_carry_forward", """WITH $bars, cal AS (SELECT DISTINCT date FROM bars),
g AS (SELECT code, cal.date FROM (SELECT code, min(date) AS lo FROM bars GROUP BY code) s
      JOIN cal ON cal.date >= s.lo)
SELECT g.code, CAST(g.date AS VARCHAR) AS date, b.close FROM g ASOF JOIN bars b
  ON g.code = b.code AND g.date >= b.date""")
def d8(spark, sf):
    b = base.bars(spark, sf)
    return E.carry_forward(b, S.calendar(b), ["close"]).select("code", "date", "close")


@query("d9_forward_as_of", """WITH $bars, $filings, cal AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_idx FROM (SELECT DISTINCT date FROM bars))
SELECT code, year, quarter, CAST(disclosed_at AS VARCHAR) AS disclosed_at,
       CAST((SELECT min(day_idx) FROM cal WHERE cal.date >= disclosed_at) AS DOUBLE) AS day_idx
FROM filings WHERE disclosed_at IS NOT NULL""")
def d9(spark, sf):
    f = base.filings(spark, sf).where(F.col("disclosed_at").isNotNull()).select(
        "code", "year", "quarter", "disclosed_at")
    return AO.first_day_on_or_after(f, S.calendar(base.bars(spark, sf)), "disclosed_at").withColumn(
        "day_idx", F.col("day_idx").cast("double"))


# ---------------------------------------------------------------- point in time

_ASOF_SQL = """p AS (SELECT code, date FROM bars WHERE volume >= 45),
seen AS (SELECT p.code, p.date, f.year, f.quarter, f.disclosed_at, f.debt_ratio_pct,
                f.current_ratio_pct, f.capital_impaired, f.op_income_quarter,
                row_number() OVER (PARTITION BY p.code, p.date
                  ORDER BY f.year DESC, f.quarter DESC, f.disclosed_at DESC) AS rn
         FROM p LEFT JOIN filings f ON p.code = f.code AND f.disclosed_at <= p.date),
known_f AS (SELECT * FROM seen WHERE rn = 1)"""


def _probes(spark, sf):
    return base.bars(spark, sf).where("volume >= 45").select("code", "date")


@query("d1_as_of", f"""WITH $bars, $filings, {_ASOF_SQL}
SELECT code, CAST(date AS VARCHAR) AS date, CAST(year AS DOUBLE) AS year,
       CAST(quarter AS DOUBLE) AS quarter, CAST(disclosed_at AS VARCHAR) AS disclosed_at,
       debt_ratio_pct, CAST(op_income_quarter AS DOUBLE) AS op_income_quarter FROM known_f""")
def d1(spark, sf):
    return AO.as_of(_probes(spark, sf), base.filings(spark, sf),
                    columns=["debt_ratio_pct", "op_income_quarter"]).withColumns(
        {c: F.col(c).cast("double") for c in ("year", "quarter", "op_income_quarter")})


@query("d2_as_of_panel", """WITH $filings, s AS (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, quarter DESC, disclosed_at DESC) AS rn
  FROM filings WHERE disclosed_at <= DATE '1999-06-30')
SELECT code, year, quarter, CAST(disclosed_at AS VARCHAR) AS disclosed_at, current_ratio_pct, equity
FROM s WHERE rn = 1""")
def d2(spark, sf):
    return AO.as_of_panel(base.filings(spark, sf), "1999-06-30",
                          columns=["current_ratio_pct", "equity"])


_STREAK_SQL = """pf AS (
  SELECT p.code, p.date, f.year * 4 + f.quarter AS q, arg_max(f.disclosed_at, f.disclosed_at) AS at
  FROM p JOIN filings f ON p.code = f.code AND f.disclosed_at <= p.date GROUP BY 1, 2, 3),
pv AS (SELECT pf.*, f.op_income_quarter AS v, max(q) OVER (PARTITION BY pf.code, pf.date) AS top
       FROM pf JOIN filings f ON pf.code = f.code AND pf.q = f.year * 4 + f.quarter
        AND pf.at = f.disclosed_at),
isl AS (SELECT *, top - q AS back, row_number() OVER (PARTITION BY code, date ORDER BY q DESC) - 1 AS rn
        FROM pv),
run AS (SELECT *, min(CASE WHEN back = rn AND coalesce(v > 0, false) THEN 1 ELSE 0 END)
               OVER (PARTITION BY code, date ORDER BY q DESC ROWS UNBOUNDED PRECEDING) AS ok FROM isl),
streak AS (SELECT code, date, CASE WHEN bool_or(back = 0 AND v IS NULL) THEN NULL
                  ELSE least(CAST(sum(ok) AS BIGINT), 8) END AS n FROM run GROUP BY 1, 2)"""


@query("d3_profit_streak", f"""WITH $bars, $filings, {_ASOF_SQL}, {_STREAK_SQL}
SELECT p.code, CAST(p.date AS VARCHAR) AS date, CAST(n AS DOUBLE) AS profit_quarters
FROM p LEFT JOIN streak s ON p.code = s.code AND p.date = s.date""")
def d3(spark, sf):
    return AO.consecutive_profit_quarters(_probes(spark, sf), base.filings(spark, sf)).withColumn(
        "profit_quarters", F.col("profit_quarters").cast("double"))


_VERDICT_SQL = """v AS (
  SELECT a.*, s.n, CASE
    WHEN coalesce(debt_ratio_pct >= 200, false) OR coalesce(current_ratio_pct <= 90, false)
      OR coalesce(n < 1, false) THEN 'fail'
    WHEN a.year IS NULL OR debt_ratio_pct IS NULL OR current_ratio_pct IS NULL OR n IS NULL THEN 'unknown'
    ELSE 'pass' END AS verdict
  FROM known_f a LEFT JOIN streak s ON a.code = s.code AND a.date = s.date)"""
_FILTERS = {"debt_ratio_max": 200.0, "current_ratio_min": 90.0, "profitable_quarters_min": 1}


@query("c14_verdicts", f"""WITH $bars, $filings, {_ASOF_SQL}, {_STREAK_SQL}, {_VERDICT_SQL}
SELECT code, CAST(date AS VARCHAR) AS date, verdict FROM v""")
def c14(spark, sf):
    return U.judge_events(_probes(spark, sf), base.filings(spark, sf), **_FILTERS).select(
        "code", "date", "verdict")


@query("c18_filtered_events", f"""WITH $bars, $filings, {_ASOF_SQL}, {_STREAK_SQL}, {_VERDICT_SQL}
SELECT code, CAST(date AS VARCHAR) AS date FROM v WHERE verdict = 'pass'
  AND coalesce(NOT capital_impaired, false)""")
def c18(spark, sf):
    return U.filter_events(_probes(spark, sf), base.filings(spark, sf), on_missing="exclude",
                           drop_impaired=True, **_FILTERS)


@query("c19_missing_financials", f"""WITH $bars, $filings, {_ASOF_SQL}, {_STREAK_SQL}, {_VERDICT_SQL}
SELECT count(DISTINCT CASE WHEN verdict = 'unknown' THEN code END) AS missing_financials,
       round(count(DISTINCT CASE WHEN verdict = 'unknown' THEN code END) * 100.0::DOUBLE
             / count(DISTINCT code), 2) AS missing_financials_pct FROM v""")
def c19(spark, sf):
    return U.missing_financials(U.judge_events(_probes(spark, sf), base.filings(spark, sf),
                                               **_FILTERS))
