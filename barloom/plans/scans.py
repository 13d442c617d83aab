"""Registered queries: scans, projections, predicates (groups A, B, C, E1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..sources import bars as S
from . import base
from .base import query, rounded


@query("bars_daily", """WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date, open, round(high, 4) AS high, round(low, 4) AS low,
       close, volume, amount FROM bars""")
def bars_daily(spark, sf):
    return rounded(base.bars(spark, sf), 4, "high", "low")


@query("a2_normalize_bars", """WITH $raw_bars
SELECT code, CAST(date AS VARCHAR) AS date, round(close, 6) AS close,
       CASE WHEN CAST(code AS BIGINT) % 4 <> 0 THEN volume END AS volume, amount, name, dept,
       CAST(halted AS BIGINT) AS halted FROM raw_bars""")
def normalize_bars(spark, sf):
    """Raw text bars (short codes, text numbers, NaN) through the cleaner."""
    sk = F.col("code").cast("bigint")
    raw = base.raw_bars(spark, sf).select(
        F.date_format("date", "yyyy-MM-dd").alias("Date"), sk.cast("string").alias("Code"),
        F.col("name").alias("Name"), F.when(F.col("dept") != "", F.col("dept")).alias("Dept"),
        *[F.col(c).cast("string").alias(c.capitalize()) for c in ("open", "high", "low", "close")],
        F.when(sk % 4 == 0, "n/a").otherwise(F.col("volume").cast("string")).alias("Volume"),
        F.col("amount").alias("Amount"))
    out = S.normalize_bars(raw)
    return rounded(out, 6, "close").select(
        "code", "date", "close", "volume", "amount", "name", "dept",
        F.col("halted").cast("bigint").alias("halted"))


@query("a3_code_variants", """WITH $bars
SELECT code, count(*) AS bars FROM bars WHERE code = '000007' GROUP BY code""")
def code_variants(spark, sf):
    raw = base.bars(spark, sf).withColumn("code", F.col("code").cast("bigint").cast("string"))
    return (S.raw_symbol_rows(raw, "7", "code").select(C.pad_code("code").alias("code"))
            .groupBy("code").agg(F.count(F.lit(1)).alias("bars")))


@query("a4_halted_mask", """WITH $raw_bars
SELECT code, count(*) AS bars, CAST(count(*) FILTER (WHERE NOT coalesce(open > 0 AND high > 0 AND
       low > 0 AND close > 0, false)) AS BIGINT) AS halted_bars FROM raw_bars GROUP BY code""")
def halted_mask(spark, sf):
    return (base.raw_bars(spark, sf).withColumn("halted", S.halted()).groupBy("code")
            .agg(F.count(F.lit(1)).alias("bars"), F.count_if("halted").alias("halted_bars")))


@query("a5_panel", """WITH $raw_bars
SELECT code, CAST(date AS VARCHAR) AS date, round(close, 6) AS close, amount,
       CAST(halted AS BIGINT) AS halted
FROM raw_bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
def panel(spark, sf):
    out = S.panel(base.raw_bars(spark, sf), "1997-01-01", "1997-12-31", ["close", "amount"],
                  adjusted=False)
    return rounded(out, 6, "close").withColumn("halted", F.col("halted").cast("bigint"))


# fixed definition of the factor in SQL: 1 / product of the share ratios of all later splits
FACTOR_SQL = """before_split AS (
  SELECT *, lag(stocks) OVER w AS ps, lag(close) OVER w AS pcl FROM raw_bars
  WINDOW w AS (PARTITION BY code ORDER BY date)),
at_split AS (SELECT *, coalesce(ps > 0 AND stocks > 0 AND (stocks / ps >= 1.5 OR stocks / ps <= 1 / 1.5::DOUBLE),
                          false) AS cand,
              coalesce(close / nullif(pcl, 0) * (stocks / ps) BETWEEN 0.7 AND 1.3, false) AS smooth FROM before_split),
fa AS (SELECT *, cand AND smooth AS split, 1 / coalesce(product(CASE WHEN cand AND smooth THEN stocks / ps
              ELSE 1 END) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING
              AND UNBOUNDED FOLLOWING), 1) AS factor FROM at_split),
adjusted AS (SELECT * EXCLUDE (ps, pcl, cand, smooth, split, factor) REPLACE (open * factor AS open,
               high * factor AS high, low * factor AS low, close * factor AS close) FROM fa)"""


@query("a5_adjusted_panel", f"""WITH $raw_bars, {FACTOR_SQL}
SELECT code, CAST(date AS VARCHAR) AS date, round(open, 6) AS open, round(close, 6) AS close, volume
FROM adjusted WHERE date BETWEEN DATE '1997-10-01' AND DATE '1998-03-31'""")
def adjusted_panel(spark, sf):
    """A range before most of the splits: its prices still refer to the newest day."""
    out = S.panel(base.raw_bars(spark, sf), "1997-10-01", "1998-03-31", ["open", "close", "volume"])
    return rounded(out, 6, "open", "close").drop("halted")


@query("a6_symbol_bars", """WITH $raw_bars
SELECT CAST(date AS VARCHAR) AS date,
       round(open * f2, 6) AS open, round(high * f2, 6) AS high, round(low * f2, 6) AS low,
       round(close * f2, 6) AS close, volume, amount, stocks, CAST(halted AS BIGINT) AS halted
FROM (SELECT *, CASE WHEN date < (SELECT min(date) FROM raw_bars WHERE code = '000003'
                                  AND stocks = 2000000) THEN 0.5 ELSE 1 END AS f2
      FROM raw_bars WHERE code = '000003')
WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""")
def symbol_bars(spark, sf):
    out = S.symbol_bars(base.raw_bars(spark, sf), "3", "1998-01-01", "1998-12-31")
    return rounded(out, 6, "open", "high", "low", "close").withColumn(
        "halted", F.col("halted").cast("bigint"))


@query("a13_table_status", """WITH $bars
SELECT CAST(min(date) AS VARCHAR) AS min_date, CAST(max(date) AS VARCHAR) AS max_date,
       count(*) AS rows, count(DISTINCT year(date)) AS years FROM bars""")
def table_status(spark, sf):
    return S.table_status(base.bars(spark, sf))


@query("a15_names", """WITH $raw_bars, day AS (SELECT code, name FROM raw_bars
         WHERE date = DATE '2001-11-30')
SELECT code, name FROM day
UNION ALL
SELECT code, arg_max(name, date) FROM raw_bars WHERE NOT EXISTS (SELECT 1 FROM day) GROUP BY code""")
def names(spark, sf):
    """The asked day lies after the data, so every code falls back to its last name."""
    return S.names(base.raw_bars(spark, sf), "2001-11-30")


@query("a15_names_on_day", """WITH $raw_bars
SELECT code, name FROM raw_bars WHERE date = DATE '1997-06-16'""")
def names_on_day(spark, sf):
    return S.names(base.raw_bars(spark, sf), "1997-06-16")


@query("a16_symbol_snapshot", """WITH $raw_bars
SELECT code, name, market, CAST(round(marcap / 1e8) AS BIGINT) AS marcap_eok FROM raw_bars
WHERE date = (SELECT max(date) FROM raw_bars)""")
def symbol_snapshot(spark, sf):
    return S.symbol_snapshot(base.raw_bars(spark, sf))


@query("a17_trading_days", """WITH $bars
SELECT CAST(date AS VARCHAR) AS date, row_number() OVER (ORDER BY date) - 1 AS day_idx
FROM (SELECT DISTINCT date FROM bars)""")
def trading_days(spark, sf):
    return S.calendar(base.bars(spark, sf))


@query("b1_sources", """WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date, open, volume,
       round((high + low) / 2, 6) AS hl2, round((high + low + close) / 3, 6) AS hlc3,
       round((high + low + close) / 3, 6) AS typical,
       round((open + high + low + close) / 4, 6) AS ohlc4 FROM bars""")
def sources(spark, sf):
    out = base.bars(spark, sf).select(
        "code", "date", *[C.source(s).alias(s) for s in
                          ("open", "volume", "hl2", "hlc3", "typical", "ohlc4")])
    return rounded(out, 6, "hl2", "hlc3", "typical", "ohlc4")


@query("b5_prev", """WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date, lag(close) OVER w AS prev_close,
       round(lag(high) OVER w, 4) AS prev_high FROM bars
WINDOW w AS (PARTITION BY code ORDER BY date)""")
def prev(spark, sf):
    return rounded(base.bars(spark, sf).select(
        "code", "date", C.prev("close").alias("prev_close"), C.prev("high").alias("prev_high")),
        4, "prev_high")


@query("b7_arithmetic", """WITH $bars
SELECT code, CAST(date AS VARCHAR) AS date, round(close / nullif(volume - 25, 0), 8) AS quotient,
       CASE WHEN volume <> 25 THEN floor(close / (volume - 25)) END AS whole,
       CASE WHEN volume <> 25 THEN round(close - (volume - 25) * floor(close / (volume - 25)), 4) END
         AS remainder,
       round(pow(close / 1000, 3), 6) AS cubed, round(-close + 2 * open - 1, 4) AS mixed
FROM bars""")
def arithmetic(spark, sf):
    c, d = F.col("close"), F.col("volume") - 25
    return base.bars(spark, sf).select(
        "code", "date", F.round(C.divide(c, d), 8).alias("quotient"),
        C.floor_divide(c, d).alias("whole"), F.round(C.floor_mod(c, d), 4).alias("remainder"),
        F.round(C.power(c / 1000, F.lit(3)), 6).alias("cubed"),
        F.round(-c + 2 * F.col("open") - 1, 4).alias("mixed"))


@query("b11_json_rows", """WITH $bars
SELECT code, count(*) AS rows, max('{"date":"' || CAST(date AS VARCHAR) || '","volume":'
       || CAST(CAST(volume AS BIGINT) AS VARCHAR) || '}') AS last_row
FROM bars GROUP BY code""")
def json_rows(spark, sf):
    row = F.to_json(F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"),
                             F.col("volume").cast("bigint").alias("volume")))
    return base.bars(spark, sf).groupBy("code").agg(
        F.count(F.lit(1)).alias("rows"), F.max(row).alias("last_row"))


_CONDITION_SQL = """WITH $bars, x AS (
  SELECT *, lag(close) OVER w AS pc, lag(open) OVER w AS po FROM bars
  WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code,
  CAST(count(*) FILTER (WHERE coalesce(close > pc, false)) AS BIGINT) AS rises,
  CAST(count(*) FILTER (WHERE NOT coalesce(close > pc, false)) AS BIGINT) AS not_rises,
  CAST(count(*) FILTER (WHERE coalesce(close <> pc, false)) AS BIGINT) AS changes,
  CAST(count(*) FILTER (WHERE coalesce(close > pc, false) AND volume >= 30) AS BIGINT) AS both_true,
  CAST(count(*) FILTER (WHERE coalesce(close > pc, false) OR volume >= 30) AS BIGINT) AS any_true,
  CAST(count(*) FILTER (WHERE coalesce(close > 1050 AND pc <= 1050, false)) AS BIGINT) AS above_level,
  CAST(count(*) FILTER (WHERE coalesce(close < open AND pc >= po, false)) AS BIGINT) AS below_open,
  count(*) AS always
FROM x GROUP BY code"""


@query("c1_conditions", _CONDITION_SQL)
def conditions(spark, sf):
    """Comparison, AND, OR, NOT, crossings and the empty condition, all two-valued."""
    rise = P.compare(F.col("close"), ">", C.prev("close"))
    busy = P.compare(F.col("volume"), ">=", 30)
    flags = {
        "rises": rise, "not_rises": P.negate(rise),
        "changes": P.compare(F.col("close"), "!=", C.prev("close")),
        "both_true": P.all_of(rise, busy), "any_true": P.any_of(rise, busy),
        "above_level": P.cross_above(F.col("close"), 1050.0),
        "below_open": P.cross_below(F.col("close"), F.col("open")), "always": P.all_of(),
    }
    flagged = base.bars(spark, sf).select("code", *[f.alias(n) for n, f in flags.items()])
    return flagged.groupBy("code").agg(*[F.count_if(n).alias(n) for n in flags])


@query("e1_latest_rows", """WITH $raw_bars
SELECT code, CAST(max(date) AS VARCHAR) AS date, round(arg_max(close, date), 6) AS close,
       arg_max(market, date) AS market FROM raw_bars GROUP BY code""")
def latest_rows(spark, sf):
    return rounded(S.latest_rows(base.raw_bars(spark, sf), ["close", "market"]), 6, "close")
