from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from barloom.operators import matching as M
from barloom.operators import metrics as PM
from barloom.operators import views as V
from barloom.sources.bars import calendar


def flat(c, n):
    return [(c, c * 1.01, c * 0.99, c)] * n


def plan(*more, **kw):
    entries = (M.Entry("B1", when=F.col("low") <= F.col("ref.open"), target=F.col("ref.open"), size_pct=40), *more)
    return M.Plan(entries=entries, **{**dict(exits=(M.Exit("TP", "take_profit", pct=50.0),), slippage=0.0,
                                             fee=0.0, notional=10_000.0), **kw})


def run(bars, p, **kw):
    return M.trade_ledger(M.match_trades(M.index_bars(bars), p, **kw), p).orderBy("code", "ref_date", "part").collect()


PATH = [(100, 101, 99, 100), (100, 100, 99, 99), (98, 99, 97.5, 98), (98, 98, 94, 95), (95, 96, 94, 95), (96, 98, 95, 97)]


def test_third_rule_requires_the_first(make_bars):
    """A rung 2 % down that waits for B1 alone is filled before the 5 % rung."""
    bars = make_bars({"A": PATH + flat(97, 3)}, events={("A", 0)})
    p = plan(M.Entry("B2", drop_pct=-5.0, size_pct=30), M.Entry("B3", drop_pct=-2.0, requires=("B1",), size_pct=30))
    (t,) = run(bars, p)
    assert [(f.rule, f.price) for f in t.fills] == [("B1", 100.0), ("B3", 98.0), ("B2", 95.0)]
    days = [r.date for r in bars.orderBy("date").collect()]
    assert [days.index(f.date) for f in t.fills] == [1, 2, 3]
    cost = sum(f.qty * f.price for f in t.fills)
    assert t.qty == sum(f.qty for f in t.fills) and t.avg_price == pytest.approx(cost / t.qty)


def test_ladder_rule_with_a_condition(make_bars):
    bars = make_bars({"A": PATH + flat(97, 3)}, events={("A", 0)})
    p = plan(M.Entry("B2", when=F.col("close") > F.col("open"), size_pct=30))
    (t,) = run(bars, p)
    assert [(f.rule, f.price) for f in t.fills] == [("B1", 100.0), ("B2", 97.0)]
    p = plan(M.Entry("B2", when=F.col("close") > F.col("open"), target=F.col("low"), size_pct=30))
    assert run(bars, p)[0].fills[1].price == 95.0


def test_a_rule_that_requires_a_later_one_waits_a_bar(make_bars):
    bars = make_bars({"A": PATH + flat(94, 3)}, events={("A", 0)})
    p = plan(M.Entry("B2", drop_pct=-2.0, requires=("B3",), drop_from="B1", size_pct=30),
             M.Entry("B3", drop_pct=-5.0, requires=("B1",), size_pct=30))
    (t,) = run(bars, p)
    days = [r.date for r in bars.orderBy("date").collect()]
    assert [(f.rule, days.index(f.date)) for f in t.fills] == [("B1", 1), ("B3", 3), ("B2", 4)]


@pytest.mark.parametrize("more", [
    (M.Entry("B2", drop_pct=-1.0, requires=("B3",)), M.Entry("B3", drop_pct=-1.0, requires=("B2",))),
    (M.Entry("B2", drop_pct=-1.0, requires=("X",)),), (M.Entry("B2", drop_pct=-1.0, requires=("B2",)),),
    (M.Entry("B2"),), (M.Entry("B2", drop_pct=-1.0, when=F.lit(True) if False else None, requires=("B1", "Y")),)])
def test_impossible_ladders_are_refused(more):
    with pytest.raises(ValueError):
        plan(*more).ladder()


def test_exit_priority(make_bars):
    """One bar meets target and stop; the first named rule sells."""
    bars = make_bars({"A": [(100, 101, 99, 100), (100, 100, 99, 100), (100, 112, 85, 100)] + flat(100, 2)}, events={("A", 0)})
    rules = (M.Exit("TP", "take_profit", pct=10.0), M.Exit("SL", "stop_loss", pct=10.0))
    p = plan(exits=rules, same_day_exit="never")
    assert run(bars, p)[0].exit_rule == "TP"
    assert run(bars, replace(p, priority=("SL",)))[0].exit_rule == "SL"
    assert [e.id for e in replace(p, priority=("SL", "TP")).exits] == ["SL", "TP"]


def test_open_positions_end_with_the_run(make_bars):
    """Symbol B stops trading early: it is sold on the run's last day at its last close."""
    bars = make_bars({"A": [(100, 101, 99, 100)] * 8, "B": [(100, 101, 99, 100)] * 8}, events={("A", 0), ("B", 0)})
    days = [r.date for r in bars.where("code = 'A'").orderBy("date").collect()]
    bars = bars.where((F.col("code") == "A") | (F.col("date") < days[4]))
    got = {t.code: t for t in run(bars, plan())}
    assert {c: (t.exit_rule, t.exit_date, t.hold_days) for c, t in got.items()} == {
        c: ("EOD", days[7], (days[7] - days[1]).days) for c in "AB"}
    cut = {t.code: t.exit_date for t in run(bars, plan(), end=str(days[5]))}
    assert cut == {"A": days[5], "B": days[5]}
    marks = V.trade_markers(M.index_bars(bars), M.trade_ledger(M.match_trades(M.index_bars(bars), plan()), plan()))
    assert {(r.code, r.idx) for r in marks.where("mark = 'sell'").collect()} == {("A", 8), ("B", 4)}


def test_an_order_for_the_next_open_needs_a_bar_inside_the_run(make_bars):
    bars = make_bars({"A": [(100, 101, 99, 100)] + [(90, 91, 89, 90)] * 5}, events={("A", 0)})
    days = [r.date for r in bars.orderBy("date").collect()]
    p = plan(fill="next_open")
    assert run(bars, p, end=str(days[1])) == []
    assert run(bars, p, end=str(days[2]))[0].entry_date == days[2]


def test_many_references_of_one_symbol(spark):
    """100,000 candidates; the greedy choice is that of a plain loop."""
    rng = random.Random(4)
    rows = [("A", i, i + rng.choice([0, 1, 2, 60])) for i in range(1, 100_001)] + [("B", 5, 9)]
    trades = spark.createDataFrame(rows, "code string, ref_idx int, exit_idx int")
    want, last = set(), -1
    for _, ref, out in rows[:-1]:
        if ref > last:
            want.add(ref)
            last = out
    got = M.non_overlapping(trades)
    assert {r.ref_idx for r in got.where("code = 'A'").select("ref_idx").collect()} == want
    assert got.where("code = 'B'").count() == 1


def brute_equity(fills, sales, bars, days, initial):
    cash, held, close, out = initial, {}, {}, []
    for d in days:
        for c, x, px in bars:
            if x == d:
                close[c] = px
        for c, x, q, px in fills:
            if x == d:
                cash -= q * px
                held[c] = held.get(c, 0) + q
        for c, x, q, px in sales:
            if x == d:
                cash += q * px
                held[c] -= q
        out.append(cash + sum(q * close[c] for c, q in held.items() if q))
    return out


def test_equity_is_a_sweep_over_held_bars(spark):
    """Two symbols, missing bars inside a holding period, two trades of one symbol."""
    days = [dt.date(2024, 1, i) for i in range(1, 11)]
    rng = random.Random(1)
    bars = [(c, d, float(rng.randint(80, 120))) for c in "AB" for d in days if rng.random() < 0.7 or d.day in (2, 3)]
    fills = [("A", days[1], 5, 100.0), ("A", days[6], 2, 90.0), ("B", days[2], 7, 95.0)]
    sales = [("A", days[4], 5, 99.0), ("A", days[9], 2, 91.0), ("B", days[8], 3, 97.0), ("B", days[9], 4, 88.0)]
    fill = "struct<rule:string,date:date,price:double,qty:bigint>"
    one = lambda f: [("B1", f[1], f[3], f[2])]
    ledger = spark.createDataFrame(
        [("A", "g1", 1, one(fills[0]), days[1], days[4], 5, 99.0), ("A", "g2", 1, one(fills[1]), days[6], days[9], 2, 91.0),
         ("B", "g3", 1, one(fills[2]), days[2], days[8], 3, 97.0), ("B", "g3", 2, one(fills[2]), days[2], days[9], 4, 88.0)],
        f"code string, group_id string, part int, fills array<{fill}>, entry_date date, exit_date date, "
        "qty bigint, exit_price double")
    table = spark.createDataFrame(bars, "code string, date date, close double")
    cal = calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    got = [r.value for r in PM.daily_equity(ledger, table, cal, initial=1e5, fee=0.0).orderBy("date").collect()]
    assert got == pytest.approx(brute_equity(fills, sales, bars, days, 1e5))
    held = V.holding_bars(table, ledger.select("code", "group_id", "part", "entry_date", "exit_date", "qty"), ["qty"])
    want = sorted((c, d, p.part, p.qty) for p in ledger.collect() for c, d, _ in bars
                  if c == p.code and p.entry_date <= d <= p.exit_date)
    assert sorted((r.code, r.date, r.part, r.qty) for r in held.collect()) == want


def test_next_flagged_moves_flagged_bars_alone(spark, make_bars):
    """The next true bar comes from a union with the probes; no probe joins the table of bars."""
    path = [(10, 11, 9, 10 + (1 if i % 4 == 0 else -1)) for i in range(12)]
    bars = M.index_bars(make_bars({"a": path}, halted={("a", 4)}))
    probes = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 5), ("a", 4, 9), ("a", 5, 10), ("a", 6, 40)],
                                   "code string, probe int, start_idx int")
    out = M._next_flagged(bars, probes, {"hit": (F.col("close") > F.col("open"), F.lit(None))})
    got = {r.probe: r.hit and r.hit.hit_idx for r in out.collect()}
    assert got == {1: 1, 2: 9, 3: 9, 4: 9, 5: None, 6: None}
    joins = [f._jdf.queryExecution().optimizedPlan().toString().count("Join ") for f in (bars, out)]
    assert joins[0] == joins[1]    # the calendar's
