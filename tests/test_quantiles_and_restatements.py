from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import halted_free, with_indicators
from barloom.operators import adjust as A
from barloom.operators import filings as FO
from barloom.operators import quality as Q
from barloom.operators.quantiles import exact_quantiles
from barloom.sources import bars as S


@pytest.mark.parametrize("rows, hot", [(1, 0.0), (2, 0.0), (400, 0.0), (3000, 0.4)])
def test_exact_quantiles_equal_numpy(spark, rows, hot):
    rng = random.Random(rows)
    values = [(7.0 if rng.random() < hot else round(rng.gauss(0, 100), rng.choice([0, 3])),
               None if rng.random() < 0.3 else float(rng.randint(0, 5))) for _ in range(rows)]
    df = spark.createDataFrame([(*v, None) for v in values], "a double, b double, c double").repartition(7)
    points = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    got = {r.column: r for r in exact_quantiles(df, ["a", "b", "c"], points).collect()}
    for name, known in (("a", [v[0] for v in values]), ("b", [v[1] for v in values if v[1] is not None])):
        if known:
            assert got[name].n == len(known)
            np.testing.assert_allclose(got[name].q, np.quantile(known, points), rtol=1e-12, atol=1e-9)
    assert "c" not in got


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([(x,) for x in (math.inf, math.inf, -math.inf, math.nan, None)], "x double")
    (r,) = exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]).collect()
    assert (r.n, r.q) == (3, [-math.inf, math.inf, math.inf])
    assert exact_quantiles(df.limit(0), ["x"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, ["x"], [1.5])


def test_no_task_holds_all_values(spark):
    """Distinct values are spread over the tasks; only two of them are looked at again."""
    df = spark.range(20_000).select((F.col("id") * 1.0).alias("x"))
    (r,) = Q.distribution(df, ["x"]).collect()
    assert (r.n, r.min, r.p25, r.median, r.max) == (20_000, 0.0, 4999.75, 9999.5, 19999.0)
    (a,) = Q.distribution(df, ["x"], approximate=True).collect()
    assert abs(a.median - r.median) < 20_000 / 1000


def filing(spark, rows):
    return spark.createDataFrame([(c, y, q, d, fs, v) for c, y, q, d, fs, v in rows],
                                 "corp_code string, year int, quarter int, disclosed_at date, "
                                 "fs_div string, op_income bigint")


def quarterly(spark, rows):
    got = FO.quarterly_from_cumulative(filing(spark, rows)).collect()
    return {(r.quarter, r.disclosed_at, r.op_income): r.op_income_quarter for r in got}


def day(m, d):
    return dt.date(2024, m, d)


def test_each_row_subtracts_what_was_known_on_its_day(spark):
    """The second quarter is restated twice, once before and once after the third is disclosed."""
    got = quarterly(spark, [
        ("A", 2024, 1, day(5, 15), "CFS", 100), ("A", 2024, 2, day(8, 14), "CFS", 250),
        ("A", 2024, 2, day(10, 1), "CFS", 240), ("A", 2024, 2, day(12, 1), "CFS", 230),
        ("A", 2024, 3, day(11, 14), "CFS", 420), ("A", 2024, 3, day(12, 20), "CFS", 400)])
    assert got == {(1, day(5, 15), 100): 100, (2, day(8, 14), 250): 150, (2, day(10, 1), 240): 140,
                   (2, day(12, 1), 230): 130, (3, day(11, 14), 420): 180, (3, day(12, 20), 400): 170}


def test_versions_without_a_day_and_other_bases(spark):
    got = quarterly(spark, [
        ("A", 2024, 1, None, "CFS", 90), ("A", 2024, 2, day(8, 14), "CFS", 250),
        ("A", 2024, 1, day(9, 1), "CFS", 100), ("A", 2024, 2, None, "CFS", 255),
        ("A", 2024, 3, day(7, 1), "CFS", 400), ("A", 2024, 4, day(12, 31), "OFS", 500)])
    # an undated version is the oldest one; an undated row sees every version
    assert got[2, day(8, 14), 250] == 160 and got[2, None, 255] == 155
    # the undated half year is known in July; another basis is not subtracted
    assert got[3, day(7, 1), 400] == 145 and got[4, day(12, 31), 500] is None


def test_restatement_of_the_future_is_not_seen(spark):
    got = quarterly(spark, [("A", 2024, 2, day(8, 14), "CFS", 250), ("A", 2024, 1, day(9, 1), "CFS", 100),
                            ("A", 2024, 2, day(9, 1), "CFS", 260)])
    assert got[2, day(8, 14), 250] is None and got[2, day(9, 1), 260] == 160


def test_random_versions_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"C{rng.randint(0, 4)}", 2024, rng.randint(1, 4),
             rng.choice([None, *(day(m, 1) for m in range(1, 13))]), rng.choice(["CFS", "OFS"]),
             i * 1000 + rng.randint(0, 999)) for i in range(200)]
    got = quarterly(spark, rows)
    low = dt.date(1, 1, 1)
    for c, y, q, d, fs, v in rows:
        seen = [(e or low, w, g) for b, x, p, e, g, w in rows
                if (b, x, p) == (c, y, q - 1) and (d is None or e is None or e <= d)]
        want = v if q == 1 else v - max(seen)[1] if seen and max(seen)[2] == fs else None
        assert got[q, d, v] == want


# ---------------------------------------------------------------- adjusted ranges

def split_bars(spark):
    days = [dt.date(2024, 1, i) for i in range(1, 11)]
    price = [100.0] * 4 + [50.0] * 3 + [25.0] * 3
    shares = [1e6] * 4 + [2e6] * 3 + [4e6] * 3
    rows = [("A", d, p, p + 1, p - 1, p, 10.0, n, False) for d, p, n in zip(days, price, shares)]
    rows += [("B", d, 9.0, 9.5, 8.5, 9.0, 5.0, 1e6, False) for d in days]
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, "
                                       "close double, volume double, stocks double, halted boolean")


def test_a_range_is_adjusted_by_later_splits(spark):
    bars = split_bars(spark)
    whole = {(r.code, r.date): r.close for r in A.adjust_prices(bars).collect()}
    cut = S.panel(bars, "2024-01-02", "2024-01-06", ["close", "volume"]).collect()
    assert {(r.code, r.date): r.close for r in cut} == {k: v for k, v in whole.items()
                                                       if 2 <= k[1].day <= 6}
    assert {r.close for r in cut if r.code == "A"} == {25.0} and {r.volume for r in cut} == {10.0, 5.0}
    raw = S.panel(bars, "2024-01-02", "2024-01-06", ["close"], adjusted=False).collect()
    assert {r.close for r in raw if r.code == "A"} == {100.0, 50.0}
    assert S.panel(bars.drop("stocks"), columns=["close"]).where("close = 100").count() == 4


def test_halted_free_reads_the_bars_once(spark):
    days = [dt.date(2024, 1, i) for i in range(1, 9)]
    rows = [("A", d, float(i), i in (2, 5)) for i, d in enumerate(days)]
    bars = spark.createDataFrame(rows, "code string, date date, close double, halted boolean")
    out = halted_free(bars, {"m": ("SMA", {"period": 2})})
    assert out.columns == [*bars.columns, "m"]
    live = with_indicators(bars.where("NOT halted"), {"m": ("SMA", {"period": 2})}).collect()
    want = {r.date: r.m for r in live}
    assert {r.date: r.m for r in out.collect()} == {d: want.get(d) for d in days}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0
