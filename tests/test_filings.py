from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import predicates as P
from barloom.operators import asof as AO
from barloom.operators import filings as FO
from barloom.operators import quality as Q
from barloom.operators import universe as U

SCHEMA = ("code string, corp_code string, fs_div string, currency string, year int, quarter int, disclosed_at date, "
          "cur_assets long, cur_liab long, assets long, liab long, equity long, revenue long, op_income long, net_income long")


def row(code, y, q, d, op, **kw):
    base = dict(fs_div="CFS", cur_assets=200, cur_liab=100, assets=500, liab=150, equity=350, revenue=300, net_income=25)
    v = {**base, **kw}
    return (code, "00" + code, v["fs_div"], "KRW", y, q, d, v["cur_assets"], v["cur_liab"], v["assets"], v["liab"],
            v["equity"], v["revenue"], op, v["net_income"])


D = {1: dt.date(2024, 5, 15), 2: dt.date(2024, 8, 14), 3: dt.date(2024, 11, 14), 4: dt.date(2025, 3, 11)}


def derived(spark, rows):
    return FO.derive_columns(spark.createDataFrame(rows, SCHEMA))


def test_quarterly_income(spark):
    f = derived(spark, [row("000010", 2024, q, D[q], op) for q, op in zip((1, 2, 3, 4), (100, 250, 420, 600))])
    assert [r.op_income_quarter for r in f.orderBy("quarter").collect()] == [100, 150, 170, 180]
    gap = derived(spark, [row("000010", 2024, 1, D[1], 100), row("000010", 2024, 3, D[3], 420)])
    assert [r.op_income_quarter for r in gap.orderBy("quarter").collect()] == [100, None]
    mixed = derived(spark, [row("000010", 2024, 1, D[1], 100, fs_div="OFS"), row("000010", 2024, 2, D[2], 250)])
    assert [r.op_income_quarter for r in mixed.orderBy("quarter").collect()] == [100, None]


@pytest.mark.parametrize("kw,ratio,reason", [
    ({}, 42.86, "ok"), ({"equity": 0}, None, "nonpositive"), ({"equity": -5}, None, "nonpositive"),
    ({"equity": None}, None, "missing"), ({"equity": 1, "assets": 20000}, None, "tiny")])
def test_guarded_ratio(spark, kw, ratio, reason):
    f = derived(spark, [row("000010", 2024, 1, D[1], 100, **kw)])
    from barloom.functions.columns import ratio_reason
    r = f.withColumn("why", ratio_reason("liab", "equity", "assets")).first()
    assert (r.debt_ratio_pct, r.why) == (ratio, reason)


def _streak(spark, quarters, date):
    f = derived(spark, [row("000010", y, q, d, 0) for y, q, d, _ in quarters])
    ops = {(y, q, d): op for y, q, d, op in quarters}
    values = spark.createDataFrame([(y, q, d, op) for (y, q, d), op in ops.items()],
                                   "year int, quarter int, disclosed_at date, op_income_quarter long")
    f = f.drop("op_income_quarter").join(values, ["year", "quarter", "disclosed_at"])
    p = spark.createDataFrame([("000010", date)], "code string, date date")
    return AO.consecutive_profit_quarters(p, f).first().profit_quarters


def test_profit_streaks(spark):
    q = [(2024, n, D[n], v) for n, v in zip((1, 2, 3, 4), (5, -1, 3, 4))]
    assert _streak(spark, q, dt.date(2025, 6, 1)) == 2
    assert _streak(spark, q, dt.date(2024, 12, 1)) == 1
    assert _streak(spark, q, dt.date(2024, 9, 1)) == 0
    assert _streak(spark, q, dt.date(2024, 1, 1)) is None
    assert _streak(spark, [(2024, 1, D[1], 5), (2024, 3, D[3], 5)], dt.date(2025, 1, 1)) == 1
    assert _streak(spark, [(2024, 1, D[1], 5), (2024, 2, D[2], None)], dt.date(2025, 1, 1)) is None
    restated = [(2024, 1, D[1], 5), (2024, 1, dt.date(2024, 7, 1), -5)]
    assert _streak(spark, restated, dt.date(2024, 6, 1)) == 1
    assert _streak(spark, restated, dt.date(2024, 7, 1)) == 0


def test_as_of_equals_range_join_and_never_looks_ahead(spark):
    rng = random.Random(5)
    rows = []
    for c in range(30):
        for y in range(2020, 2024):
            for q in (1, 2, 3, 4):
                d = dt.date(y, q * 3, 28) + dt.timedelta(days=rng.randint(30, 95))
                rows.append(row(f"{c:06d}", y, q, None if rng.random() < 0.1 else d, rng.randint(-50, 200)))
                if rng.random() < 0.2:
                    rows.append(row(f"{c:06d}", y, q, d + dt.timedelta(days=rng.randint(1, 400)), rng.randint(-50, 200)))
    rng.shuffle(rows)
    f = derived(spark, rows)
    probes = spark.createDataFrame(
        [(f"{rng.randint(0, 31):06d}", dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 1800)), i) for i in range(300)],
        "code string, date date, n int")
    cols = ["op_income"]
    a = {tuple(r) for r in AO.as_of(probes, f, columns=cols).collect()}
    b = {tuple(r) for r in AO.as_of_range_join(probes, f, columns=cols).select(
        *AO.as_of(probes, f, columns=cols).columns).collect()}
    assert a == b
    assert AO.as_of(probes, f).where(F.col("disclosed_at") > F.col("date")).count() == 0
    assert Q.lookahead_audit(f).agg(F.sum("violations")).first()[0] == 0

    def blind(probes, filings, columns=None):     # an as-of join that ignores the date
        best = filings.groupBy("code").agg(F.max(F.struct("year", "quarter", "disclosed_at")).alias("f"))
        return probes.join(best, "code").select(*probes.columns, "f.*")

    assert Q.lookahead_audit(f, lookup=blind).agg(F.sum("violations")).first()[0] > 0


def test_disclosure_is_visible_on_its_own_day(spark):
    f = derived(spark, [row("000010", 2024, 1, D[1], 100)])
    p = spark.createDataFrame([("000010", D[1] - dt.timedelta(days=1)), ("000010", D[1])], "code string, date date")
    assert [r.quarter for r in AO.as_of(p, f).orderBy("date").collect()] == [None, 1]


def test_known_failure_beats_unknown(spark):
    df = spark.createDataFrame([(1, True, 300., None), (2, True, 50., None), (3, True, 50., 150.), (4, False, None, None)],
                               "i int, f boolean, debt_ratio_pct double, current_ratio_pct double")
    v = P.fundamentals_verdict(has_filing=F.col("f"), debt_ratio_max=200.0, current_ratio_min=100.0)
    out = df.withColumn("v", v).orderBy("i")
    assert [r.v for r in out.collect()] == ["fail", "unknown", "pass", "unknown"]
    assert [r.i for r in out.where(P.keep_verdict("v", "exclude")).collect()] == [3]


def test_filter_uses_the_event_date(spark):
    f = derived(spark, [row("000010", 2024, 1, D[1], 100, liab=1000)])
    ev = spark.createDataFrame([("000010", D[1] - dt.timedelta(days=1)), ("000010", D[1])], "code string, date date")
    kept = U.filter_events(ev, f, debt_ratio_max=200.0).collect()
    assert [r.date for r in kept] == [D[1] - dt.timedelta(days=1)]


def test_quarter_gaps(spark):
    f = spark.createDataFrame([(2015, 4)] * 10 + [(2016, 1)] * 10 + [(2016, 3)] * 2, "year int, quarter int")
    asked = spark.createDataFrame([(2016, 2)], "year int, quarter int")
    got = {(r.year, r.quarter): r.state for r in Q.quarter_gaps(f, asked, "2017-01-31").collect()}
    assert got == {(2015, 1): "no_coverage", (2015, 2): "no_coverage", (2015, 3): "no_coverage", (2015, 4): "ok",
                   (2016, 1): "ok", (2016, 2): "no_data", (2016, 3): "thin", (2016, 4): "not_due"}


def test_preferred_statement_and_first_amount(spark):
    items = [(2024, 1, 0, "1", "", "OFS", "매출액", "1", "KRW", "20240515000001"),
             (2024, 1, 1, "1", "005930", "CFS", "매출액", "-", "", "20240515000001"),
             (2024, 1, 2, "1", "005930", "CFS", "매출액", "(2,000)", "KRW", "20240516000001"),
             (2024, 1, 3, "1", "005930", "CFS", "영업수익", "9", "KRW", "")]
    df = spark.createDataFrame(items, "year int, quarter int, pos int, corp_code string, stock_code string, fs_div string, "
                                      "account_nm string, thstrm_amount string, currency string, rcept_no string")
    r = FO.pivot_items(df).first()
    assert (r.corp_code, r.fs_div, r.revenue, r.stock_code, r.currency) == ("00000001", "CFS", -2000, "005930", "KRW")
    assert r.disclosed_at == dt.date(2024, 5, 16)


def test_first_trading_day_on_or_after(spark):
    cal = spark.createDataFrame([(dt.date(2024, 1, 2), 0), (dt.date(2024, 1, 5), 1)], "date date, day_idx int")
    days = [dt.date(2001, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 5), dt.date(2024, 1, 6)]
    asked = spark.createDataFrame([(d,) for d in days], "date date")
    got = {r.date: r.day_idx for r in AO.first_day_on_or_after(asked, cal).collect()}
    assert [got[d] for d in days] == [0, 0, 1, 1, None]


def test_profit_streak_walks_each_disclosure_once(spark):
    rows = [("a", 2024, q, D[q], 1) for q in (1, 2, 4)] + [("b", 2024, 1, D[1], 5), ("b", 2024, 2, D[2], -5),
            ("b", 2024, 2, D[3], 5), ("c", 2024, 1, D[1], None)]
    filings = spark.createDataFrame([(c, y, q, d, v) for c, y, q, d, v in rows],
                                    "code string, year int, quarter int, disclosed_at date, op_income_quarter long")
    steps = AO.profit_streaks(filings)
    got = {(r.code, r.disclosed_at): r.profit_quarters for r in steps.collect()}
    assert got == {("a", D[1]): 1, ("a", D[2]): 2, ("a", D[4]): 1, ("b", D[1]): 1, ("b", D[2]): 0,
                   ("b", D[3]): 2, ("c", D[1]): None}
    # the visible filings are filtered once for a disclosure, not once for a period
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") <= 2 and "transform(" not in plan
