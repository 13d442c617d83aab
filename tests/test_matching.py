from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import predicates as P
from barloom.functions.indicators import with_indicators
from barloom.operators import matching as M
from barloom.operators import metrics as PM
from barloom.sources.bars import calendar

FALL = [(4000, 5200, 3980, 4900), (4880, 4900, 4600, 4700), (4690, 4710, 4400, 4500),
        (4490, 4510, 4150, 4200), (4150, 4180, 3900, 3950), (3940, 3960, 3800, 3820),
        (3810, 3830, 3700, 3720), (3710, 3730, 3550, 3600)]
UP = [(3610, 3750, 3600, 3740), (3750, 3920, 3730, 3900), (3910, 4070, 3890, 4050), (4060, 4250, 4040, 4200)]
DOWN = [(3550, 3560, 3000, 3050), (3040, 3050, 2500, 2550), (2540, 2550, 1900, 1950), (1900, 1920, 1500, 1550)]


def flat(c, n):
    return [(c, c * 1.01, c * 0.99, c)] * n


def path(tail):
    rise = [(c - 30, c + 30, c - 60, c) for c in range(1150, 4001, 150)]
    body = flat(1000, 80) + rise + FALL + tail
    return body + flat(body[-1][3], 200 - len(body))


def ladder(**kw):
    base = dict(entries=(M.Entry("B1", when=F.col("low") <= F.col("ref.open"), target=F.col("ref.open"), size_pct=50),
                         M.Entry("B2", drop_pct=-10.0, size_pct=50)),
                exits=(M.Exit("SL", "condition", flag="hit", target="ma45"), M.Exit("TP", "take_profit", pct=10.0)),
                gate="close_below_reference_open", same_day_exit="loss_only", notional=10_000_000.0)
    return M.Plan(**{**base, **kw})


def run(bars, plan):
    df = with_indicators(bars, {"ma45": ("SMA", {"period": 45})})
    df = df.withColumn("hit", P.known(F.col("low") <= F.col("ma45")))
    return M.trade_ledger(M.match_trades(M.index_bars(df), plan), plan).orderBy("code", "ref_date", "part").collect()


def test_ladder_take_profit(make_bars):
    """Second buy 10 % lower, exit 10 % above the average (fills as in the published scenario)."""
    bars = make_bars({"100010": path(UP)}, events={("100010", 100)})
    plan = ladder()
    (t,) = run(bars, plan)
    assert [(f.rule, f.qty) for f in t.fills] == [("B1", 1248), ("B2", 1387)]
    assert [f.price for f in t.fills] == pytest.approx([4004.0, 3603.6])
    assert t.exit_rule == "TP" and t.exit_price == pytest.approx(t.avg_price * 1.10 * 0.999)
    assert t.avg_price == pytest.approx((1248 * 4004 + 1387 * 3603.6) / (1248 + 1387))


def test_stop_at_average(make_bars):
    bars = make_bars({"100010": path(DOWN)}, events={("100010", 100)})
    (t,) = run(bars, ladder())
    assert t.exit_rule == "SL" and t.pnl < 0
    days = [r.date for r in bars.orderBy("date").collect()]
    assert days.index(t.exit_date) == 110


def one(entries=None, **kw):
    e = entries or (M.Entry("B1", when=F.col("low") <= F.col("ref.open"), target=F.col("ref.open")),)
    return M.Plan(entries=e, **{**dict(exits=(M.Exit("TP", "take_profit", pct=10.0),), slippage=0.0, fee=0.0,
                                       notional=100_000.0), **kw})


def test_gap_fills_at_the_open(make_bars):
    bars = make_bars({"A": [(100, 101, 99, 100)] + [(95, 96, 94, 95), (120, 121, 119, 120)] + flat(120, 3)}, events={("A", 0)})
    (t,) = run(bars, one())
    assert t.avg_price == 95.0 and t.exit_price == 120.0


def test_no_entry_on_the_event_bar_and_expiry(make_bars):
    quiet = [(100, 101, 99, 100)] + [(105, 106, 104, 105)] * 5
    bars = make_bars({"A": quiet + [(99, 100, 98, 99)] + flat(99, 3)}, events={("A", 0)})
    assert run(bars, one(valid_days=5)) == []
    assert len(run(bars, one(valid_days=6))) == 1


def test_same_day_policies(make_bars):
    """Entry and target on one bar: profit allowed only under 'always'."""
    bars = make_bars({"A": [(100, 101, 99, 100), (100, 112, 98, 105), (106, 111, 104, 110)] + flat(100, 3)}, events={("A", 0)})
    held = {p: run(bars, one(same_day_exit=p))[0].hold_days for p in ("always", "never", "loss_only")}
    assert held["always"] == 0 and held["never"] > 0 and held["loss_only"] > 0
    stop = (M.Exit("SL", "stop_loss", pct=1.0),)
    held = {p: run(bars, one(same_day_exit=p, exits=stop))[0].hold_days for p in ("always", "never", "loss_only")}
    assert held["always"] == held["loss_only"] == 0 and held["never"] > 0


def test_close_entry_is_never_sold_on_its_bar(make_bars):
    bars = make_bars({"A": [(100, 101, 99, 100), (100, 120, 98, 100), (101, 120, 100, 100)] + flat(100, 2)}, events={("A", 0)})
    plan = one(entries=(M.Entry("B1", when=F.col("low") <= F.col("ref.open")),), same_day_exit="always")
    (t,) = run(bars, plan)
    assert t.hold_days == 1


def test_halted_bars_never_fill_but_count(make_bars):
    p = [(100, 101, 99, 100), (100, 101, 99, 100)] + [(100, 101, 99, 100)] * 3 + flat(100, 3)
    bars = make_bars({"A": p}, events={("A", 0)}, halted={("A", 1), ("A", 3)})
    (t,) = run(bars, one(exits=(M.Exit("TX", "time_exit", bars=1),)))
    days = [r.date for r in bars.orderBy("date").collect()]
    assert days.index(t.fills[0].date) == 2 and days.index(t.exit_date) == 4


def test_partial_exits_share_the_group(make_bars):
    bars = make_bars({"A": [(100, 101, 99, 100), (100, 100, 99, 100), (104, 106, 103, 105), (111, 112, 110, 111), (80, 81, 79, 80)]},
                     events={("A", 0)})
    plan = one(exits=(M.Exit("P1", "take_profit", pct=5.0, size_pct=50), M.Exit("P2", "take_profit", pct=10.0, size_pct=50),
                      M.Exit("SL", "stop_loss", pct=10.0)))
    t = run(bars, plan)
    assert [(x.exit_rule, x.qty, x.part) for x in t] == [("P1", 500, 1), ("P2", 250, 2), ("SL", 250, 3)]
    assert len({x.group_id for x in t}) == 1 and {x.avg_price for x in t} == {100.0}


def test_forced_close(make_bars):
    bars = make_bars({"A": [(100, 101, 99, 100)] * 6}, events={("A", 0)})
    (t,) = run(bars, one())
    assert t.exit_rule == "EOD" and t.exit_price == 100.0


def test_positions_do_not_overlap(make_bars):
    bars = make_bars({"A": [(100, 101, 99, 100)] * 9}, events={("A", i) for i in (0, 2, 4)})
    out = run(bars, one(exits=(M.Exit("TX", "time_exit", bars=3),)))
    assert len(out) == 1        # events at 2 and 4 fall into the holding period 1-4


def test_first_crossing_against_brute_force(spark, make_bars):
    rng = np.random.default_rng(3)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 400)))
    rows = [(float(p), float(p * 1.01), float(p * 0.99), float(p)) for p in px]
    stops = {("A", int(i)) for i in rng.integers(0, 400, 30)}
    bars = M.index_bars(make_bars({"A": rows}, halted=stops)).cache()
    data = {r.idx: r for r in bars.collect()}
    probes, want = [], {}
    for n in range(400):
        kind = ("up", "down", "trail")[n % 3]
        s = int(rng.integers(1, 400))
        e = int(rng.integers(s, 401))
        peak = int(rng.integers(1, s + 1))
        level = float(0.93 if kind == "trail" else px[s - 1] * rng.uniform(0.85, 1.15))
        probes.append(("A", n, kind, level, s, e, peak))
        best = 0.0
        for i in range(min(peak, s) if kind == "trail" else s, e + 1):
            b = data[i]
            if b.halted:
                continue
            best = max(best, b.high)
            if i >= s and (b.high >= level if kind == "up" else b.low <= (best * level if kind == "trail" else level)):
                want[n] = i
                break
    p = spark.createDataFrame(probes, "code string, probe int, kind string, level double, start_idx int, end_idx int, peak_idx int")
    got = {r.probe: r.hit_idx for r in M.first_crossing(bars, p, trailing=True).collect()}
    assert got == want
    plain = {k: v for k, v in want.items() if k % 3 != 2}
    assert {r.probe: r.hit_idx for r in M.first_crossing(bars, p.where("kind <> 'trail'")).collect()} == plain


def test_equity_ends_at_cash(make_bars):
    bars = make_bars({"A": [(100, 101, 99, 100), (100, 100, 99, 100), (104, 111, 103, 105)] + flat(105, 3)}, events={("A", 0)})
    plan = one()
    df = M.index_bars(bars)
    ledger = M.trade_ledger(M.match_trades(df, plan), plan)
    eq = PM.daily_equity(ledger, bars, calendar(bars), initial=1e6, fee=0.0)
    values = [r.value for r in eq.orderBy("date").collect()]
    assert values[0] == 1e6 and values[1] == 1e6 and values[-1] == pytest.approx(1e6 + 1000 * 10)
    p = PM.performance(eq, initial=1e6).first()
    assert p.total_return_pct == pytest.approx(1.0) and p.mdd_pct == 0.0


def test_carry_forward_keeps_the_last_known_value(spark):
    from barloom.operators.events import carry_forward
    bars = spark.createDataFrame(
        [("a", dt.date(2024, 1, d), c) for d, c in ((1, 10.0), (2, None), (4, None))],
        "code string, date date, close double")
    cal = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in range(1, 6)],
                                "date date, day_idx int")
    got = carry_forward(bars, cal, ["close"]).orderBy("date").collect()
    assert [r.close for r in got] == [10.0] * 5


def test_reference_expires_by_trading_days_of_the_market(make_bars):
    """Symbol B is not listed on most days; its reference ages with the market's calendar."""
    bars = make_bars({"A": flat(100, 12), "B": flat(100, 12)}, events={("B", 0)})
    days = [r.date for r in bars.where("code = 'A'").orderBy("date").collect()]
    bars = bars.where((F.col("code") == "A") | F.col("date").isin(days[0], days[3], days[9]))
    got = M.active_reference(M.index_bars(bars), 5).collect()
    assert [(r.code, r.date) for r in got] == [("B", days[3])]
    assert M.active_reference(M.index_bars(bars, calendar(bars)), 9).count() == 2


def test_fills_after_a_partial_sale_are_counted(spark):
    """The second buy shows only in the ledger row of the second sale."""
    d = [dt.date(2024, 1, i) for i in range(1, 6)]
    fill = "struct<rule:string,date:date,price:double,qty:bigint>"
    ledger = spark.createDataFrame(
        [("A", "g", 1, [("B1", d[0], 10.0, 5)], d[0], d[1], 2, "P1", 1),
         ("A", "g", 2, [("B1", d[0], 10.0, 5), ("B2", d[2], 9.0, 4)], d[0], d[3], 7, "SL", 3)],
        f"code string, group_id string, part int, fills array<{fill}>, entry_date date, "
        "exit_date date, qty bigint, exit_rule string, hold_days int")
    assert sorted((r.f.rule, r.f.qty) for r in M.position_fills(ledger).collect()) == [("B1", 5), ("B2", 4)]
    bars = spark.createDataFrame([("A", x, 1.0, False) for x in d], "code string, date date, amount double, is_event boolean")
    log = M.activity_log(bars, ledger).where("text LIKE 'buy%'").orderBy("date").collect()
    assert [(r.date, r.text) for r in log] == [(d[0], "buy B1 5"), (d[2], "buy B2 4")]


def test_second_buy_at_the_limit_counts(spark):
    d = [dt.date(2024, 1, i) for i in range(1, 6)]
    px = [100.0, 100.0, 130.0, 130.0, 130.0]        # day 3 closes 30 % up at its high
    bars = spark.createDataFrame([("A", x, c, c, c, c, False) for x, c in zip(d, px)],
                                 "code string, date date, open double, high double, low double, close double, halted boolean")
    fill = "struct<rule:string,date:date,price:double,qty:bigint>"
    ledger = spark.createDataFrame(
        [("A", "g", 1, [("B1", d[0], 100.0, 5)], d[0], d[1], "P1"),
         ("A", "g", 2, [("B1", d[0], 100.0, 5), ("B2", d[2], 130.0, 4)], d[0], d[3], "SL")],
        f"code string, group_id string, part int, fills array<{fill}>, entry_date date, exit_date date, exit_rule string")
    assert PM.quality_counters(bars, ledger).first().limit_price_fills == 1


def test_exit_rules_of_a_position_share_one_row(make_bars):
    """F14 of round 3: positions must not become a row per rule and span."""
    bars = M.index_bars(make_bars({"A": [(100, 101, 99, 100), (100, 100, 99, 100), (104, 106, 103, 105), (80, 81, 79, 80)]},
                                  events={("A", 0)}))
    plan = one(exits=(M.Exit("P1", "take_profit", pct=5.0, size_pct=50), M.Exit("SL", "stop_loss", pct=10.0),
                      M.Exit("P2", "take_profit", pct=90.0)), same_day_exit="always")
    seg = M.entry_candidates(bars, plan).selectExpr(
        "code", "ref_idx", "idx0 AS seg_start", "100 AS seg_end", "idx0 AS entry_idx", "px0 AS avg",
        "CAST(array() AS ARRAY<INT>) AS done")
    (row,) = M.exit_hits(bars, seg, plan).collect()
    assert [(h.rule, h.hit_idx, h.px) for h in row.hits if h] == [(0, 3, 105.0), (1, 4, 80.0)]


def test_crossings_of_odd_rows(spark):
    """No code, missing and NaN prices, gaps, probes without level or of an unknown symbol."""
    d = [dt.date(2024, 1, i) for i in range(1, 7)]
    none, nan = None, float("nan")
    rows = [("A", d[0], 1, 10.0, 9.0, False), ("A", d[1], 2, 20.0, 5.0, True), ("A", d[2], 3, none, none, False),
            ("A", d[3], 5, nan, 8.0, False), ("A", d[4], 6, 12.0, 7.0, False), (none, d[0], 1, 99.0, 1.0, False),
            ("B", d[5], 1, 50.0, 40.0, False)]
    bars = spark.createDataFrame(rows, "code string, date date, idx int, high double, low double, halted boolean")
    bars = bars.selectExpr("*", "high AS open", "low AS close", "low AS next_open", "date AS next_date")
    asks = [("A", 1, "up", 11.0, 1, 9), ("A", 2, "down", 8.0, 1, 9), ("A", 3, "down", 8.0, 1, 4),
            ("A", 4, "up", none, 1, 9), ("A", 5, "up", 10.0, 2, 4), (none, 6, "up", 1.0, 1, 9),
            ("C", 7, "up", 1.0, 1, 9), ("B", 8, "up", 50.0, -5, 2 ** 31 - 1), ("A", 9, "down", float("inf"), 2, 9)]
    probes = spark.createDataFrame(asks, "code string, probe int, kind string, level double, start_idx int, end_idx int")
    got = {r.probe: (r.hit_idx, r.hit_date) for r in M.first_crossing(bars, probes).collect()}
    assert got == {1: (5, d[3]), 2: (5, d[3]), 8: (1, d[5]), 9: (5, d[3])}


def test_whole_panel_moves_its_bars_once(spark):
    """F9 of round 3: a panel without a range needs no second pass over the bars for the splits."""
    from barloom.operators import adjust as A
    from barloom.sources import bars as S
    rows = [("a", dt.date(2024, 1, i), p, s) for i, p, s in ((1, 100.0, 1e6), (2, 102.0, 1e6), (3, 51.0, 2e6), (4, 17.0, 6e6))]
    rows += [("b", dt.date(2024, 1, 1), 7.0, 1e6), ("b", dt.date(2024, 1, 2), 8.0, None)]
    bars = spark.createDataFrame(rows, "code string, date date, close double, stocks double").selectExpr("*", "close > 0 AS halted")
    whole = S.panel(bars, columns=["close"])
    assert whole.columns == ["date", "code", "close", "halted"]
    steps = A.scale_by_steps(bars.select("date", "code", "close", "halted"), A.factor_steps(bars))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, steps.collect()))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") <= 1
