"""Registered queries: chart, search, sorting and set views (A18, D11, E17-E18, G, H)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.indicators import with_indicators
from ..operators import matching as M
from ..operators import metrics as PM
from ..operators import views as V
from ..sources import bars as S
from ..sources.staging import stage
from . import base
from .base import query, rounded
from .trade_queries import (_LEDGER_OUT, _PARTIAL_SQL, _bars, _ledger, _shown, _touch, _trades_sql, partial_plan)


@query("a18_chart_arrays", """WITH $raw_bars, m AS (
  SELECT *, CASE WHEN count(*) OVER f = 20 THEN avg(volume) OVER f END AS v20 FROM raw_bars
  WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT code, count(*) AS n, CAST(sum(CAST(strftime(date, '%Y%m%d') AS BIGINT)) AS BIGINT) AS t_sum,
       CAST(count(*) FILTER (WHERE NOT halted) AS BIGINT) AS prices,
       CAST(arg_max(CAST(strftime(date, '%Y%m%d') AS BIGINT), date) AS BIGINT) AS last_t,
       round(arg_max(close, date) FILTER (WHERE NOT halted), 6) AS last_close,
       CAST(count(v20) AS BIGINT) AS averages
FROM m GROUP BY code""")
def a18(spark, sf):
    """Arrays per symbol; checked through their sizes, sums and last elements."""
    b = with_indicators(base.raw_bars(spark, sf), {"v20": ("SMA", {"source": "volume"})})
    arrays = V.chart_arrays(b, {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume",
                                "amt": "amount", "halted": "halted", "v20": "v20"})
    known = F.filter("c", lambda x: x.isNotNull())
    return arrays.select(
        "code", F.size("t").cast("bigint").alias("n"),
        F.aggregate(F.transform("t", lambda x: x.cast("bigint")), F.lit(0).cast("bigint"),
                    lambda a, x: a + x).alias("t_sum"),
        F.size(known).cast("bigint").alias("prices"),
        F.element_at("t", -1).cast("bigint").alias("last_t"),
        F.round(F.element_at(known, -1), 6).alias("last_close"),
        F.size(F.filter("v20", lambda x: x.isNotNull())).cast("bigint").alias("averages"))


@query("e17_downsample", """WITH $raw_bars, x AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY code ORDER BY date) - 1) * 40
         / count(*) OVER (PARTITION BY code)) AS BIGINT) AS bucket FROM raw_bars)
SELECT code, bucket, CAST(min(date) AS VARCHAR) AS first_date, round(arg_min(open, date), 6) AS open,
       round(max(high), 5) AS high, round(min(low), 5) AS low, round(arg_max(close, date), 6) AS close,
       max(amount) AS amount, CAST(arg_max(close, date) >= arg_min(open, date) AS BIGINT) AS up
FROM x WHERE NOT halted GROUP BY code, bucket""")
def e17(spark, sf):
    out = V.downsample(base.raw_bars(spark, sf), 40)
    out = rounded(rounded(out, 6, "open", "close"), 5, "high", "low")
    return out.withColumn("up", F.col("up").cast("bigint"))


@query("e18_price_range", """WITH $raw_bars, m AS (
  SELECT *, CASE WHEN count(*) OVER f = 20 THEN avg(close) OVER f END AS ma FROM raw_bars
  WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
r AS (SELECT code, min(least(low, ma)) AS lo, max(greatest(high, ma)) AS hi FROM m
      WHERE NOT halted AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY code)
SELECT code, round(lo - (hi - lo) * 0.06::DOUBLE, 5) AS axis_low,
       round(hi + (hi - lo) * 0.06::DOUBLE, 5) AS axis_high FROM r""")
def e18(spark, sf):
    b = with_indicators(base.raw_bars(spark, sf), {"ma": ("SMA", {})})
    b = S.panel(b, "1997-01-01", "1998-12-31", adjusted=False)
    return rounded(V.price_range(b, ["ma"]), 5, "axis_low", "axis_high")


_SNAP = """snap AS (SELECT code, name, market, CAST(round(marcap / 1e8) AS BIGINT) AS marcap_eok
  FROM raw_bars WHERE date = (SELECT max(date) FROM raw_bars))"""


@query("g1_symbol_search", f"""WITH $raw_bars, {_SNAP}, r AS (
  SELECT *, CASE WHEN upper(code) = '00' THEN 0 WHEN upper(name) = '00' THEN 1
     WHEN starts_with(upper(name), '00') THEN 2 WHEN starts_with(upper(code), '00') THEN 3
     WHEN contains(upper(name), '00') THEN 4 WHEN contains(upper(code), '00') THEN 5 END AS rank FROM snap)
SELECT code, name, market, marcap_eok, rank, (SELECT count(*) FROM r WHERE rank IS NOT NULL) AS total
FROM r WHERE rank IS NOT NULL ORDER BY rank, coalesce(marcap_eok, 0) DESC, code LIMIT 10""")
def g1(spark, sf):
    return V.search_symbols(S.symbol_snapshot(base.raw_bars(spark, sf)), "00", 10)


@query("g2_symbols_by_size", f"""WITH $raw_bars, {_SNAP}
SELECT code, marcap_eok FROM snap""")
def g2(spark, sf):
    """All symbols by size."""
    return V.symbols_by_size(S.symbol_snapshot(base.raw_bars(spark, sf))).select(
        "code", "marcap_eok")


@query("g3_default_symbol", f"""WITH $raw_bars, {_SNAP}
SELECT code FROM snap ORDER BY marcap_eok DESC NULLS LAST, code LIMIT 1""")
def g3(spark, sf):
    return V.default_symbol(S.symbol_snapshot(base.raw_bars(spark, sf)))


@query("g4_top_contributors", _PARTIAL_SQL + """
SELECT code, count(*) AS trades, round(sum(pnl), 0) AS pnl FROM ledger GROUP BY code
ORDER BY sum(pnl) DESC, code LIMIT 12""")
def g4(spark, sf):
    top = V.top_contributors(PM.by_stock(_ledger(spark, sf, partial_plan())))
    return rounded(top.select("code", "trades", "pnl"), 0, "pnl")


@query("g5_group_sorted_trades", _PARTIAL_SQL + """, s AS (
  SELECT code, CAST(ref_date AS VARCHAR) AS ref_date, part, rule AS exit_rule,
         sum(pnl) OVER (PARTITION BY code, ref_idx) AS total,
         code || '-' || CAST(ref_date AS VARCHAR) || '-' || CAST(date0 AS VARCHAR) AS group_id FROM ledger)
SELECT group_id, part, exit_rule, round(total, 0) AS group_pnl FROM s""")
def g5(spark, sf):
    out = V.group_sorted(_ledger(spark, sf, partial_plan()))
    return out.select("group_id", "part", "exit_rule", F.round("rep", 0).alias("group_pnl"))


_PRIORITY_SQL = _trades_sql(
    when="low <= r_low", px=_touch("r_low", "down"), valid=60,
    rules=[("SL", "low <= avg * 0.97::DOUBLE", _touch("(avg * 0.97::DOUBLE)", "down"), 1.0),
           ("P2", "high >= avg * 1.03::DOUBLE", _touch("(avg * 1.03::DOUBLE)", "up"), 0.5),
           ("P1", "high >= avg * 1.015::DOUBLE", _touch("(avg * 1.015::DOUBLE)", "up"), 0.5)])


@query("g8_exit_priority", _PRIORITY_SQL + _LEDGER_OUT)
def g8(spark, sf):
    """The partial plan with the stop named first: it wins on bars that meet several rules."""
    return _shown(_ledger(spark, sf, replace(partial_plan(), priority=("SL", "P2"))))


@query("h1_union_years", """WITH $bars
SELECT year(date) AS year, count(*) AS bars, CAST(sum(volume) AS DOUBLE) AS volume FROM bars GROUP BY 1""")
def h1(spark, sf):
    """Years with different columns united by name, absent columns NULL."""
    b = stage(base.bars(spark, sf), "bars")
    found = b.select(F.year("date").alias("y")).distinct().orderBy("y").collect()  # one per year
    years = [b.where(F.year("date") == r.y) for r in found]
    out = years[0].drop("amount")
    for y in years[1:]:
        out = out.unionByName(y, allowMissingColumns=True)
    return out.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))


@query("h5_prepend_history", """WITH $bars, m AS (
  SELECT *, CASE WHEN count(*) OVER f = 20 THEN avg(close) OVER f END AS ma20 FROM bars
  WINDOW f AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
cur AS (SELECT code, min(date) AS lo FROM m WHERE date >= DATE '1998-06-01' GROUP BY code)
SELECT m.code, CAST(m.date AS VARCHAR) AS date, m.close,
       CASE WHEN m.date >= cur.lo THEN round(ma20, 6) END AS ma20
FROM m LEFT JOIN cur ON m.code = cur.code
WHERE (m.date <= DATE '1998-12-31' AND (cur.lo IS NULL OR m.date < cur.lo)) OR m.date >= DATE '1998-06-01'""")
def h5(spark, sf):
    b = stage(base.bars(spark, sf).select("code", "date", "close"), "bars")
    current = with_indicators(b, {"ma20": ("SMA", {})}).where("date >= DATE '1998-06-01'")
    older = b.where("date <= DATE '1998-12-31'")
    return rounded(V.prepend_history(older, current), 6, "ma20")


_MARKS = """, mk AS (
  SELECT code, ref_idx, ref_date AS date, 'reference' AS mark FROM ledger WHERE part = 1
  UNION ALL SELECT code, ref_idx, date0, 'buy' FROM ledger WHERE part = 1
  UNION ALL SELECT l.code, l.ref_idx, least(l.exit_date, z.last), 'sell' FROM ledger l
    JOIN (SELECT code, max(date) AS last FROM b GROUP BY code) z ON l.code = z.code),
mi AS (SELECT mk.*, b.idx FROM mk JOIN b ON mk.code = b.code AND mk.date = b.date)"""


@query("d11_trade_markers", _PARTIAL_SQL + _MARKS + """
SELECT code, CAST(date AS VARCHAR) AS date, mark, idx, count(*) AS marks FROM mi GROUP BY 1, 2, 3, 4""")
def d11(spark, sf):
    bars = stage(_bars(spark, sf), "bars")
    ledger = stage(M.trade_ledger(M.match_trades(bars, partial_plan(), staged=True), partial_plan()), "ledger")
    return V.trade_markers(bars, ledger).groupBy("code", "date", "mark", "idx").agg(
        F.count(F.lit(1)).alias("marks"))


@query("d11_holding_bands", _PARTIAL_SQL + _MARKS + """
SELECT code, min(idx) FILTER (WHERE mark = 'buy') AS from_idx, max(idx) AS to_idx
FROM mi WHERE mark <> 'reference' GROUP BY code, ref_idx""")
def d11b(spark, sf):
    bars = stage(_bars(spark, sf), "bars")
    ledger = stage(M.trade_ledger(M.match_trades(bars, partial_plan(), staged=True), partial_plan()), "ledger")
    return V.holding_bands(bars, ledger).select("code", "from_idx", "to_idx")


@query("d12_holding_values", _PARTIAL_SQL + """
SELECT l.code, count(*) AS bar_days, round(sum(l.qty * b.close), 0) AS value_days
FROM ledger l JOIN raw_bars b ON l.code = b.code AND b.date BETWEEN l.date0 AND l.exit_date GROUP BY l.code""")
def d12(spark, sf):
    """Positions valued on every bar they were held."""
    bars = stage(_bars(spark, sf), "bars")
    ledger = M.trade_ledger(M.match_trades(bars, partial_plan(), staged=True), partial_plan())
    held = V.holding_bars(bars, ledger.select("code", "group_id", "part", "entry_date", "exit_date", "qty"),
                          carry=["qty"])
    return rounded(held.groupBy("code").agg(
        F.count(F.lit(1)).alias("bar_days"), F.sum(F.col("qty") * F.col("close")).alias("value_days")),
        0, "value_days")
