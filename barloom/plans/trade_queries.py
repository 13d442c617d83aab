"""Registered queries: trade matching and performance (groups K, E2-E7, F21-F25)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.indicators import with_indicators
from ..operators import events as E
from ..operators import matching as M
from ..sources.bars import panel
from ..sources.staging import stage
from . import base
from .base import query, rounded
from .scans import FACTOR_SQL


def _bars(spark, sf, with_average: bool = False):
    b = base.raw_bars(spark, sf)
    if with_average:
        b = with_indicators(b, {"ma45": ("SMA", {"period": 45})})
    b = E.flag_events(b, P.compare(F.col("volume"), ">=", 45))
    keep = ["code", "date", "open", "high", "low", "close", "volume", "amount", "halted",
            "is_event"] + (["ma45"] if with_average else [])
    return M.index_bars(b.select(*keep))


# Costs of the reference runs: 0.1 % slippage, 0.23 % on sales, 10 million per position.
SLIP, FEE, NOTIONAL = 0.001, 0.0023, 10_000_000.0


def ladder_plan() -> M.Plan:
    """Buy at the reference open, again 2 % lower; sell at the 45-day average or 3 % up."""
    return M.Plan(
        entries=(M.Entry("B1", when=F.col("low") <= F.col("ref.open"), target=F.col("ref.open"),
                         size_pct=50), M.Entry("B2", drop_pct=-2.0, size_pct=50)),
        exits=(M.Exit("SL", "condition", flag="below_ma", target="ma45", direction="down"),
               M.Exit("TP", "take_profit", pct=3.0)),
        gate="close_below_reference_open", same_day_exit="loss_only")


def trailing_plan() -> M.Plan:
    """Buy at the close of a pullback; trailing stop or ten bars."""
    return M.Plan(
        entries=(M.Entry("B1", when=F.col("close") < F.col("ref.close")),),
        exits=(M.Exit("TS", "trailing_stop", pct=4.0), M.Exit("TX", "time_exit", bars=10)),
        gate="pullback_pct", pullback_pct=-1.0, valid_days=20)


def partial_plan() -> M.Plan:
    """Half at 1.5 %, half of the rest at 3 %, everything at a 3 % stop; same day allowed."""
    return M.Plan(
        entries=(M.Entry("B1", when=F.col("low") <= F.col("ref.low"), target=F.col("ref.low")),),
        exits=(M.Exit("P1", "take_profit", pct=1.5, size_pct=50),
               M.Exit("P2", "take_profit", pct=3.0, size_pct=50),
               M.Exit("SL", "stop_loss", pct=3.0)),
        gate="close_below_reference_low", same_day_exit="always")


def next_open_plan() -> M.Plan:
    """Signals at the close, all orders at the next open, no sale on the entry day."""
    return M.Plan(
        entries=(M.Entry("B1", when=F.col("close") < F.col("ref.open"), target=F.col("close")),),
        exits=(M.Exit("TP", "take_profit", pct=2.0), M.Exit("SL", "stop_loss", pct=2.0)),
        fill="next_open", same_day_exit="never", valid_days=30)


def _ledger(spark, sf, plan: M.Plan, with_average: bool = False):
    positions = M.match_trades(_bars(spark, sf, with_average), plan)
    return M.trade_ledger(positions, plan)


def _shown(ledger):
    out = ledger.select(
        "code", "part", "ref_date", "entry_date", F.size("fills").alias("fills"), "qty",
        ((F.col("avg_price") / F.col("ref_open") - 1) * 100).alias("entry_vs_ref"),
        "exit_date",
        ((F.col("exit_price") / F.col("ref_open") - 1) * 100).alias("exit_vs_ref"),
        "exit_rule", "hold_days", "return_pct", F.round("pnl", 1).alias("pnl"))
    return rounded(rounded(out, 6, "return_pct"), 7, "entry_vs_ref", "exit_vs_ref")


_WATCH = """b AS (
  SELECT *, row_number() OVER w AS idx, dense_rank() OVER (ORDER BY date) AS dno,
         volume >= 45 AND NOT halted AS ev, lead(open) OVER w AS no,
         lead(date) OVER w AS nd, max(date) OVER () AS last_date,
         count(*) OVER (PARTITION BY code) AS last_idx,
         last_value(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
                                 AND UNBOUNDED FOLLOWING) AS last_close,
         CASE WHEN count(*) OVER f45 = 45 THEN avg(close) OVER f45 END AS ma45
  FROM raw_bars WINDOW w AS (PARTITION BY code ORDER BY date),
    f45 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 44 PRECEDING AND CURRENT ROW)),
wt AS (SELECT b.*, e.date AS ref_date, e.idx AS ref_idx, e.dno AS ref_dno, e.open AS r_open, e.low AS r_low,
        e.close AS r_close, e.amount AS r_amount FROM b ASOF JOIN (SELECT * FROM b WHERE ev) e
        ON b.code = e.code AND b.idx > e.idx)"""


def _touch(target: str, direction: str) -> str:
    op = "<=" if direction == "down" else ">="
    return (f"CASE WHEN {target} IS NULL THEN close WHEN open {op} {target} THEN open "
            f"ELSE least(greatest({target}, low), high) END")


def _trades_sql(*, when: str, px: str, valid: int, rules: list[tuple[str, str, str, float]],
                share: float = 1.0, ladder: float | None = None, shift: int = 0,
                blocked: str = "false", first_sale: int = 0, stamp: str = "date") -> str:
    """Brute force over every later bar of every candidate; rules are (id, cond, price, share)."""
    fill_idx, fill_date = (("idx + 1", "nd") if shift else ("idx", "date"))
    buy = f"* CAST({1 + SLIP!r} AS DOUBLE)"
    qty = f"CAST(floor({NOTIONAL * share!r}::DOUBLE / ({{px}} {buy})) AS BIGINT)"
    lad = (f"""c1 AS (SELECT c0.*, l.idx1 FROM c0 LEFT JOIN (
  SELECT c0.code, c0.ref_idx, min(b.idx) AS idx1 FROM c0 JOIN b ON c0.code = b.code
   AND b.idx >= c0.idx0 AND NOT b.halted AND b.low <= px0 * {1 + ladder / 100!r}::DOUBLE GROUP BY 1, 2) l
  ON c0.code = l.code AND c0.ref_idx = l.ref_idx),
c AS (SELECT c1.*, CASE WHEN c1.idx1 IS NOT NULL THEN
        {_touch(f'(px0 * {1 + ladder / 100!r}::DOUBLE)', 'down')} END AS px1
      FROM c1 LEFT JOIN b ON c1.code = b.code AND c1.idx1 = b.idx)""" if ladder is not None else
           "c AS (SELECT *, CAST(NULL AS BIGINT) AS idx1, CAST(NULL AS DOUBLE) AS px1 FROM c0)")
    hits = "\nUNION ALL ".join(
        f"""SELECT code, ref_idx, seg, s, idx, {stamp if i not in ('TS', 'TX') else 'date'} AS exit_date,
  {n} AS prio, '{i}' AS rule, {sh!r}::DOUBLE AS share, {p} AS px, avg, qty FROM h WHERE NOT halted AND ({cond})"""
        for n, (i, cond, p, sh) in enumerate(rules))
    return f"""WITH RECURSIVE $raw_bars, {_WATCH},
e0 AS (SELECT *, {px} AS px FROM wt WHERE NOT halted AND NOT ev AND dno - ref_dno <= {valid} AND ({when})),
c0 AS (SELECT code, ref_idx, any_value(ref_date) AS ref_date,
         any_value(r_open) AS r_open, any_value(last_date) AS last_date,
         any_value(last_idx) AS last_idx, any_value(last_close) AS last_close,
         arg_min({fill_idx}, idx) AS idx0, arg_min({fill_date}, idx) AS date0, arg_min(px, idx) AS px0
       FROM e0 WHERE px > 0 GROUP BY 1, 2),
{lad},
q AS (SELECT *, {qty.format(px='px0')} AS qty0, {qty.format(px='px1')} AS qty1 FROM c),
seg AS (
  SELECT *, 0 AS seg, idx0 AS s, coalesce(idx1 - 1, last_idx) AS e, qty0 AS qty, qty0 * (px0 {buy}) / qty0 AS avg FROM q
  UNION ALL
  SELECT *, 1, idx1, last_idx, qty0 + qty1,
         (qty0 * (px0 {buy}) + qty1 * (px1 {buy})) / (qty0 + qty1) FROM q WHERE idx1 IS NOT NULL),
h AS (SELECT seg.*, b.* EXCLUDE (code, last_date, last_idx, last_close),
        max(CASE WHEN NOT b.halted THEN b.high END) OVER (PARTITION BY seg.code, ref_idx ORDER BY b.idx) AS peak
      FROM seg JOIN b ON seg.code = b.code AND b.idx BETWEEN seg.s AND seg.e),
r AS ({hits}),
ok AS (SELECT *, row_number() OVER (PARTITION BY code, ref_idx, prio ORDER BY idx) AS nth FROM r
       WHERE px > 0 AND idx >= s + {first_sale} AND NOT (idx = s AND ({blocked}))),
hit AS (SELECT *, row_number() OVER (PARTITION BY code, ref_idx ORDER BY idx, prio) AS k FROM ok WHERE nth = 1),
sale AS (
  SELECT *, CASE WHEN share >= 1 THEN qty ELSE CAST(floor(qty * share) AS BIGINT) END AS sold,
         qty AS had FROM hit WHERE k = 1
  UNION ALL
  SELECT n.*, CASE WHEN n.share >= 1 THEN p.had - p.sold
              ELSE CAST(floor((p.had - p.sold) * n.share) AS BIGINT) END, p.had - p.sold
  FROM sale p JOIN hit n ON p.code = n.code AND p.ref_idx = n.ref_idx AND n.k = p.k + 1
  WHERE p.had > p.sold),
done AS (SELECT code, ref_idx, max(idx) AS last_sale, bool_or(had = sold) AS flat,
           arg_min(had - sold, had - sold) AS held, max(seg) AS seg, count(*) AS parts FROM sale WHERE sold > 0 GROUP BY 1, 2),
pos AS (SELECT q.*, coalesce(flat, false) AS flat, coalesce(parts, 0) AS parts,
          CASE WHEN coalesce(flat, false) THEN last_sale ELSE 2147483647 END AS exit_idx,
          coalesce(held, qty0 + coalesce(qty1, 0)) AS held
        FROM q LEFT JOIN done ON q.code = done.code AND q.ref_idx = done.ref_idx),
keep AS (
  SELECT code, min(ref_idx) AS ref_idx, arg_min(exit_idx, ref_idx) AS exit_idx FROM pos GROUP BY code
  UNION ALL
  SELECT p.code, min(p.ref_idx), arg_min(p.exit_idx, p.ref_idx) FROM keep k JOIN pos p
    ON p.code = k.code AND p.ref_idx > k.exit_idx GROUP BY p.code),
legs AS (
  SELECT p.code, p.ref_idx, p.ref_date, p.r_open, p.date0, row_number() OVER (PARTITION BY p.code, p.ref_idx ORDER BY k) AS part,
         s.seg + 1 AS fills, s.sold AS qty, s.avg, s.exit_date, s.px, s.rule
  FROM pos p SEMI JOIN keep k0 ON p.code = k0.code AND p.ref_idx = k0.ref_idx
  JOIN sale s ON p.code = s.code AND p.ref_idx = s.ref_idx AND s.sold > 0
  UNION ALL
  SELECT p.code, p.ref_idx, p.ref_date, p.r_open, p.date0, p.parts + 1, CASE WHEN p.idx1 IS NULL THEN 1 ELSE 2 END,
         p.held, (SELECT avg FROM seg WHERE seg.code = p.code AND seg.ref_idx = p.ref_idx
                  ORDER BY seg.seg DESC LIMIT 1), p.last_date, p.last_close, 'EOD'
  FROM pos p SEMI JOIN keep k0 ON p.code = k0.code AND p.ref_idx = k0.ref_idx WHERE NOT p.flat),
ledger AS (
  SELECT *, px * CAST({1 - SLIP!r} AS DOUBLE) AS exit_price,
         px * CAST({1 - SLIP!r} AS DOUBLE) * qty * CAST({1 - FEE!r} AS DOUBLE) - avg * qty AS pnl,
         avg * qty AS basis FROM legs)"""


_LEDGER_OUT = """
SELECT code, part, CAST(ref_date AS VARCHAR) AS ref_date, CAST(date0 AS VARCHAR) AS entry_date,
       fills, qty, round((avg / r_open - 1) * 100, 7) + 0 AS entry_vs_ref,
       CAST(exit_date AS VARCHAR) AS exit_date,
       round((exit_price / r_open - 1) * 100, 7) + 0 AS exit_vs_ref, rule AS exit_rule,
       date_diff('day', date0, exit_date) AS hold_days, round(pnl / basis * 100, 6) AS return_pct,
       round(pnl, 1) AS pnl FROM ledger"""

_NET = f"px * {1 - SLIP!r}::DOUBLE * {1 - FEE!r}::DOUBLE - avg > 0"
_LADDER_SQL = _trades_sql(
    when="low <= r_open", px=_touch("r_open", "down"), valid=60, share=0.5, ladder=-2.0,
    rules=[("SL", "low <= ma45", _touch("ma45", "down"), 1.0),
           ("TP", "high >= avg * 1.03::DOUBLE", _touch("(avg * 1.03::DOUBLE)", "up"), 1.0)],
    blocked=_NET)
_TRAIL_SQL = _trades_sql(
    when="close < r_close AND low <= r_close * 0.99::DOUBLE", px="close", valid=20,
    rules=[("TS", "low <= peak * 0.96::DOUBLE", _touch("(peak * 0.96::DOUBLE)", "down"), 1.0),
           ("TX", "idx - idx0 >= 10", "close", 1.0)], first_sale=1)
_PARTIAL_SQL = _trades_sql(
    when="low <= r_low", px=_touch("r_low", "down"), valid=60,
    rules=[("P1", "high >= avg * 1.015::DOUBLE", _touch("(avg * 1.015::DOUBLE)", "up"), 0.5),
           ("P2", "high >= avg * 1.03::DOUBLE", _touch("(avg * 1.03::DOUBLE)", "up"), 0.5),
           ("SL", "low <= avg * 0.97::DOUBLE", _touch("(avg * 0.97::DOUBLE)", "down"), 1.0)])
_NEXT_SQL = _trades_sql(
    when="close < r_open", px="no", valid=30, shift=1, stamp="nd", first_sale=1,
    rules=[("TP", "high >= avg * 1.02::DOUBLE", "no", 1.0),
           ("SL", "low <= avg * 0.98::DOUBLE", "no", 1.0)])


@query("k1_active_reference", f"""WITH $raw_bars, {_WATCH}
SELECT code, CAST(date AS VARCHAR) AS date, CAST(ref_date AS VARCHAR) AS ref_date, dno - ref_dno AS age
FROM wt WHERE NOT halted AND NOT ev AND dno - ref_dno <= 60""")
def k1(spark, sf):
    w = M.active_reference(_bars(spark, sf), 60)
    return w.select("code", "date", F.col("ref.date").alias("ref_date"),
                    (F.col("day_idx") - F.col("ref.day_idx")).alias("age"))


@query("k2_entries", _LADDER_SQL + """
SELECT code, CAST(ref_date AS VARCHAR) AS ref_date, CAST(date0 AS VARCHAR) AS entry_date,
       round(px0, 6) AS entry_price, qty0 AS qty FROM q""")
def k2(spark, sf):
    e = M.entry_candidates(_bars(spark, sf), ladder_plan())
    return e.select("code", F.col("ref.date").alias("ref_date"), F.col("date0").alias("entry_date"),
                    F.round("px0", 6).alias("entry_price"), F.col("qty0").alias("qty"))


def _fills(spark, sf, plan):
    """Candidates and their ladder; bars and candidates are read by several joins."""
    b = stage(_bars(spark, sf), "bars")
    return M.ladder_fills(b, stage(M.entry_candidates(b, plan), "candidates"), plan)


@query("k3_ladder_fills", _LADDER_SQL + """
SELECT code, CAST(ref_date AS VARCHAR) AS ref_date, idx1 - idx0 AS bars_between,
       round(px1, 6) AS second_price, qty1 AS second_qty FROM q WHERE idx1 IS NOT NULL""")
def k3(spark, sf):
    f = _fills(spark, sf, ladder_plan()).where("idx1 IS NOT NULL")
    return f.select("code", F.col("ref.date").alias("ref_date"),
                    (F.col("idx1") - F.col("idx0")).alias("bars_between"),
                    F.round("px1", 6).alias("second_price"), F.col("qty1").alias("second_qty"))


def required_plan() -> M.Plan:
    """Two independent rungs below the first buy, both waiting for it alone."""
    return replace(ladder_plan(), entries=(
        replace(ladder_plan().entries[0], size_pct=40), M.Entry("B2", drop_pct=-3.0, size_pct=30),
        M.Entry("B3", drop_pct=-1.0, requires=("B1",), size_pct=30)))


def condition_plan() -> M.Plan:
    """A rung bought at the close of the first rising bar after the first buy's drop rung."""
    return replace(ladder_plan(), entries=(
        *ladder_plan().entries, M.Entry("B3", when=F.col("close") > F.col("open"), requires=("B2",),
                                        size_pct=20)))


def _rungs_sql(base: str, rungs: list[tuple[str, str, str, str, float]], share: float) -> str:
    """Fills by brute force; rungs are (id, earlier fill, condition, price, share of the notional)."""
    sql = f""",
f0 AS (SELECT code, ref_idx, ref_date, 0 AS k, 'B1' AS rule, idx0 AS idx, px0 AS px, {share!r}::DOUBLE AS share FROM c0)"""
    for n, (name, earlier, cond, price, part) in enumerate(rungs, start=1):
        sql += f""",
h{n} AS (SELECT f.code, f.ref_idx, f.ref_date, f.px AS p, min(b.idx) AS hit FROM {earlier} f JOIN b
   ON f.code = b.code AND b.idx >= f.idx AND NOT b.halted AND ({cond}) GROUP BY ALL),
f{n} AS (SELECT h.code, h.ref_idx, h.ref_date, {n} AS k, '{name}' AS rule, h.hit AS idx, {price} AS px, {part!r}::DOUBLE AS share
   FROM h{n} h JOIN b ON h.code = b.code AND h.hit = b.idx)"""
    every = " UNION ALL ".join(f"SELECT * FROM f{n}" for n in range(len(rungs) + 1))
    return base + sql + f"""
SELECT code, CAST(ref_date AS VARCHAR) AS ref_date, row_number() OVER w AS nth, rule,
       idx - min(idx) OVER (PARTITION BY code, ref_idx) AS bars_after, round(px, 6) AS price,
       CAST(floor({NOTIONAL!r}::DOUBLE * share / (px * CAST({1 + SLIP!r} AS DOUBLE))) AS BIGINT) AS qty
FROM ({every}) WINDOW w AS (PARTITION BY code, ref_idx ORDER BY idx, k)"""


def _rungs(spark, sf, plan):
    f = _fills(spark, sf, plan)
    names = F.array(*[F.lit(e.id) for e in plan.entries])
    fills = F.array(*[F.struct(F.lit(n + 1).alias("nth"), F.element_at(names, F.col(f"rule{n}") + 1).alias("rule"),
                               (F.col(f"idx{n}") - F.col("idx0")).alias("bars_after"),
                               F.round(f"px{n}", 6).alias("price"), F.col(f"qty{n}").alias("qty"))
                      for n in range(len(plan.entries))])
    return f.select("code", F.col("ref.date").alias("ref_date"), F.inline(fills)).where("price IS NOT NULL")


@query("k3_required_fills", _rungs_sql(_LADDER_SQL, [
    ("B2", "f0", "b.low <= f.px * 0.97::DOUBLE", _touch("(p * 0.97::DOUBLE)", "down"), 0.3),
    ("B3", "f0", "b.low <= f.px * 0.99::DOUBLE", _touch("(p * 0.99::DOUBLE)", "down"), 0.3)], 0.4))
def k3_required(spark, sf):
    """The third rule requires the first one only, so it may fill before the second."""
    return _rungs(spark, sf, required_plan())


@query("k3_condition_fills", _rungs_sql(_LADDER_SQL, [
    ("B2", "f0", "b.low <= f.px * 0.98::DOUBLE", _touch("(p * 0.98::DOUBLE)", "down"), 0.5),
    ("B3", "f1", "b.close > b.open", "close", 0.2)], 0.5))
def k3_condition(spark, sf):
    """A ladder rule with a condition on the bar."""
    return _rungs(spark, sf, condition_plan())


def _with_flag(b):
    return b.withColumn("below_ma", P.known(F.col("low") <= F.col("ma45")))


def ladder_ledger(spark, sf):
    plan = ladder_plan()
    return M.trade_ledger(M.match_trades(_with_flag(_bars(spark, sf, True)), plan), plan)


@query("k6_ladder_trades", _LADDER_SQL + _LEDGER_OUT)
def k6(spark, sf):
    """Ladder entry, average-touch stop and take-profit with the loss-only same-day policy."""
    return _shown(ladder_ledger(spark, sf))


@query("k7_trailing_trades", _TRAIL_SQL + _LEDGER_OUT)
def k7(spark, sf):
    """Close entries, trailing stop and time exit."""
    return _shown(_ledger(spark, sf, trailing_plan()))


_ADJUSTED_SQL = (_TRAIL_SQL.replace("$raw_bars,", f"$raw_bars, {FACTOR_SQL},", 1)
                 .replace("FROM raw_bars WINDOW w", "FROM adjusted WINDOW w", 1))


@query("k7_adjusted_trades", _ADJUSTED_SQL + _LEDGER_OUT)
def k7_adjusted(spark, sf):
    """The trailing plan on prices adjusted for splits: a split is no crash that stops a position."""
    raw = base.raw_bars(spark, sf)
    b = E.flag_events(panel(raw, columns=["open", "high", "low", "close", "volume", "amount"]),
                      P.compare(F.col("volume"), ">=", 45))
    plan = trailing_plan()
    return _shown(M.trade_ledger(M.match_trades(M.index_bars(b), plan), plan))


_END = "1998-03-31"
_END_SQL = (_TRAIL_SQL.replace("FROM raw_bars WINDOW w", f"FROM raw_bars WHERE date <= DATE '{_END}' WINDOW w", 1))


@query("k13_period_end", _END_SQL + _LEDGER_OUT)
def k13(spark, sf):
    """A run that ends before the data: open positions are sold on the run's last trading day."""
    plan = trailing_plan()
    return _shown(M.trade_ledger(M.match_trades(_bars(spark, sf), plan, end=_END), plan))


@query("k12_partial_trades", _PARTIAL_SQL + _LEDGER_OUT)
def k12(spark, sf):
    """Partial exits of one position share a group and keep the average cost."""
    return _shown(_ledger(spark, sf, partial_plan()))


@query("k5_next_open_trades", _NEXT_SQL + _LEDGER_OUT)
def k5(spark, sf):
    """Orders filled at the next open."""
    return _shown(_ledger(spark, sf, next_open_plan()))


# ---------------------------------------------------------------- performance

from ..operators import metrics as PM  # noqa: E402
from ..sources.bars import calendar  # noqa: E402

_STATS = """count(*) AS trades, CAST(count(*) FILTER (WHERE pnl > 0) AS BIGINT) AS wins,
       CAST(count(*) FILTER (WHERE pnl < 0) AS BIGINT) AS losses,
       round(count(*) FILTER (WHERE pnl > 0) * 100.0::DOUBLE / count(*), 4) AS win_rate_pct,
       round(sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl < 0), 6) AS profit_factor,
       round(avg(pnl / basis * 100) FILTER (WHERE pnl > 0), 6) AS avg_win_pct,
       round(avg(pnl / basis * 100) FILTER (WHERE pnl < 0), 6) AS avg_loss_pct,
       round(avg(date_diff('day', date0, exit_date)), 6) AS avg_hold_days,
       round(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gross_profit,
       round(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS gross_loss"""


@query("e2_trade_stats", _PARTIAL_SQL + f"\nSELECT {_STATS} FROM ledger")
def e2(spark, sf):
    out = PM.trade_stats(_ledger(spark, sf, partial_plan()))
    out = rounded(rounded(out, 6, "profit_factor", "avg_win_pct", "avg_loss_pct", "avg_hold_days"),
                  0, "gross_profit", "gross_loss")
    return rounded(out, 4, "win_rate_pct")


@query("e3_by_stock", _PARTIAL_SQL + """
SELECT code, count(*) AS trades,
       round(count(*) FILTER (WHERE pnl > 0) * 100.0::DOUBLE / count(*), 4) AS win_rate,
       round(sum(pnl), 0) AS pnl FROM ledger GROUP BY code""")
def e3(spark, sf):
    out = PM.by_stock(_ledger(spark, sf, partial_plan()))
    return rounded(rounded(out, 4, "win_rate"), 0, "pnl")


_EQUITY_SQL = _PARTIAL_SQL + f""",
cal AS (SELECT DISTINCT date FROM raw_bars),
flow AS (
  SELECT code, date0 AS date, CAST(sum(qty) AS BIGINT) AS dq,
         -sum(qty) * any_value(avg) AS cash FROM ledger GROUP BY code, ref_idx, date0
  UNION ALL
  SELECT code, exit_date, -qty, exit_price * qty * CAST({1 - FEE!r} AS DOUBLE) FROM ledger),
cum AS (SELECT code, date, sum(sum(dq)) OVER (PARTITION BY code ORDER BY date) AS q FROM flow GROUP BY 1, 2),
mk AS (SELECT cal.date, s.code, b.close, c.q
       FROM cal CROSS JOIN (SELECT DISTINCT code FROM ledger) s
       ASOF JOIN raw_bars b ON s.code = b.code AND cal.date >= b.date
       ASOF LEFT JOIN cum c ON s.code = c.code AND cal.date >= c.date),
mv AS (SELECT date, sum(q * close) AS market FROM mk GROUP BY date),
cf AS (SELECT date, sum(cash) AS cash FROM flow GROUP BY date),
eq AS (SELECT cal.date, 1e9::DOUBLE + sum(coalesce(cash, 0)) OVER (ORDER BY cal.date) + coalesce(market, 0) AS value
       FROM cal LEFT JOIN cf USING (date) LEFT JOIN mv USING (date)),
dd AS (SELECT date, value, (value / max(value) OVER (ORDER BY date) - 1) * 100 AS drawdown FROM eq)"""

INITIAL = 1e9


def _equity(spark, sf):
    bars = stage(_bars(spark, sf), "bars")
    ledger = stage(M.trade_ledger(M.match_trades(bars, partial_plan(), staged=True), partial_plan()), "ledger")
    return PM.daily_equity(ledger, bars.select("code", "date", "close"),
                           calendar(bars), initial=INITIAL, fee=FEE)


@query("k16_equity", _EQUITY_SQL + """
SELECT CAST(date AS VARCHAR) AS date, round(value, 0) AS value, round(drawdown, 5) + 0 AS drawdown FROM dd""")
def k16(spark, sf):
    """Mark-to-market equity with drawdown."""
    return rounded(rounded(PM.drawdown(_equity(spark, sf)), 0, "value"), 5, "drawdown")


@query("f21_equity_index", _EQUITY_SQL + """
SELECT CAST(date AS VARCHAR) AS date, round(value / 1e9 * 100, 5) AS value FROM dd""")
def f21(spark, sf):
    return rounded(PM.equity_curve(_equity(spark, sf), INITIAL).select("date", "value"), 5, "value")


@query("e4_monthly_returns", _EQUITY_SQL + """, mo AS (
  SELECT strftime(date, '%Y-%m') AS month, arg_max(value, date) AS l, arg_min(value, date) AS f
  FROM eq GROUP BY 1)
SELECT month, round((l / coalesce(lag(l) OVER (ORDER BY month), f) - 1) * 100, 5) + 0 AS return_pct FROM mo""")
def e4(spark, sf):
    return rounded(PM.monthly_returns(_equity(spark, sf)), 5, "return_pct")


@query("e5_performance", _EQUITY_SQL + """, rt AS (
  SELECT *, value / lag(value) OVER (ORDER BY date) - 1 AS ret FROM dd),
ag AS (SELECT arg_max(value, date) AS fin, min(drawdown) AS mdd, stddev_samp(ret) AS sd, avg(ret) AS m,
         date_diff('day', min(date), max(date)) / 365.25::DOUBLE AS years FROM rt)
SELECT round((fin / 1e9 - 1) * 100, 5) AS total_return_pct,
       CASE WHEN fin <= 0 THEN -100 ELSE round((pow(fin / 1e9, 1 / years) - 1) * 100, 5) END AS cagr_pct,
       round((m - 0.03::DOUBLE / 252) / sd * sqrt(252), 5) AS sharpe, round(mdd, 5) AS mdd_pct,
       round(fin, 0) AS final_capital, round(years, 6) AS years FROM ag""")
def e5(spark, sf):
    out = PM.performance(_equity(spark, sf), initial=INITIAL)
    out = rounded(out, 5, "total_return_pct", "cagr_pct", "sharpe", "mdd_pct")
    return rounded(rounded(out, 0, "final_capital"), 6, "years")


@query("e19_quality_counters", _PARTIAL_SQL + """, lim AS (
  SELECT code, date, halted, (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS chg, high, low, close,
         NOT halted AND NOT coalesce(lag(halted) OVER w, true) AS live FROM raw_bars
  WINDOW w AS (PARTITION BY code ORDER BY date)),
fl AS (SELECT *, live AND chg >= 29.5 AND close >= high - 1e-9 AS up,
              live AND chg <= -29.5 AND close <= low + 1e-9 AS down FROM lim)
SELECT (SELECT CAST(count(*) FILTER (WHERE halted) AS BIGINT) FROM fl) AS halted_bars,
       (SELECT count(DISTINCT CASE WHEN halted THEN code END) FROM fl) AS halted_symbols,
       (SELECT CAST(count(*) FILTER (WHERE live AND abs(chg) > 30) AS BIGINT) FROM fl) AS extreme_moves,
       (SELECT count(*) FROM ledger l SEMI JOIN (SELECT * FROM fl WHERE up) u
          ON l.code = u.code AND l.date0 = u.date WHERE l.part = 1)
       + (SELECT count(*) FROM ledger l SEMI JOIN (SELECT * FROM fl WHERE down) u
          ON l.code = u.code AND l.exit_date = u.date WHERE l.rule <> 'EOD') AS limit_price_fills,
       CAST(count(*) FILTER (WHERE date0 = exit_date) AS BIGINT) AS same_day_trips,
       round(count(*) FILTER (WHERE date0 = exit_date) * 100.0::DOUBLE / count(*), 2) AS same_day_pct
FROM ledger""")
def e19(spark, sf):
    bars = stage(_bars(spark, sf), "bars")
    ledger = stage(M.trade_ledger(M.match_trades(bars, partial_plan(), staged=True), partial_plan()), "ledger")
    return PM.quality_counters(bars, ledger)


@query("k17_activity_log", _PARTIAL_SQL + """
SELECT level, count(*) AS rows, count(DISTINCT code) AS codes FROM (
  SELECT 'MATCH' AS level, code FROM b WHERE ev
  UNION ALL SELECT 'FILL', code FROM ledger WHERE part = 1
  UNION ALL SELECT 'FILL', code FROM ledger UNION ALL SELECT 'PNL', code FROM ledger) GROUP BY level""")
def k17(spark, sf):
    bars = stage(_bars(spark, sf), "bars")
    ledger = stage(M.trade_ledger(M.match_trades(bars, partial_plan(), staged=True), partial_plan()), "ledger")
    return M.activity_log(bars, ledger).groupBy("level").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("code").alias("codes"))


@query("f23_peak_since_entry", _TRAIL_SQL + """
SELECT l.code, CAST(l.date0 AS VARCHAR) AS entry_date, CAST(l.exit_date AS VARCHAR) AS exit_date,
       round(max(CASE WHEN NOT b.halted THEN b.high END), 6) AS peak, count(*) AS bars_held
FROM ledger l JOIN raw_bars b ON l.code = b.code AND b.date BETWEEN l.date0 AND l.exit_date
GROUP BY l.code, l.date0, l.exit_date""")
def f23(spark, sf):
    from ..operators.views import holding_bars

    bars = stage(_bars(spark, sf), "bars")
    ledger = M.trade_ledger(M.match_trades(bars, trailing_plan(), staged=True), trailing_plan())
    return rounded(holding_bars(bars, ledger).groupBy("code", "entry_date", "exit_date").agg(
        F.max(F.when(~F.col("halted"), F.col("high"))).alias("peak"),
        F.count(F.lit(1)).alias("bars_held")), 6, "peak")
