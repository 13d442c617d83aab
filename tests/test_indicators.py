from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import predicates as P
from barloom.functions.indicators import (Ewm, Indicator, REGISTRY, halted_free, spec_list, with_ewm,
                                          with_indicators)
from barloom.operators import adjust as A
from barloom.sources.bars import halted


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(7)
    n = 700
    c = 1000 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    o = c * (1 + rng.normal(0, 0.005, n))
    pdf = pd.DataFrame({"code": "000010", "date": pd.bdate_range("2020-01-01", periods=n).date,
                        "open": o, "high": np.maximum(o, c) * 1.01, "low": np.minimum(o, c) * 0.99,
                        "close": c, "volume": rng.integers(100, 10000, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).cache()


def _values(df, column):
    return np.array([np.nan if r[column] is None else r[column]
                     for r in df.orderBy("date").select(column).collect()])


def test_recursive_mean_matches_pandas_with_gaps(spark):
    x = [None, 5.0, 6.0, None, None, 9.0, 4.0, None, 8.0] * 80   # crosses the chunk length
    pdf = pd.DataFrame({"code": "A", "date": pd.date_range("2020-01-01", periods=len(x)).date, "x": x})
    df = spark.createDataFrame(pdf.astype({"x": float})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = _values(with_ewm(df, {"y": Ewm("x", 2 / 11, 3), "z": Ewm("x", 1 / 14)}), "y")
    want = pdf["x"].astype(float).ewm(alpha=2 / 11, adjust=False, min_periods=3).mean()
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("name,params,want", [
    ("EMA", {"period": 20}, lambda d: d.close.ewm(span=20, adjust=False, min_periods=20).mean()),
    ("SMA", {"period": 5}, lambda d: d.close.rolling(5).mean()),
    ("WMA", {"period": 9}, lambda d: d.close.rolling(9).apply(
        lambda w: np.dot(w, np.arange(1, 10)) / 45, raw=True)),
    ("HIGHEST", {"period": 30}, lambda d: d.close.rolling(30).max()),
    ("LOWEST", {"period": 30}, lambda d: d.close.rolling(30).min()),
    ("CCI", {"period": 20}, lambda d: ((d.high + d.low + d.close) / 3).rolling(20).apply(
        lambda w: (w[-1] - w.mean()) / (0.015 * np.abs(w - w.mean()).mean()), raw=True)),
])
def test_single_series(walk, name, params, want):
    pdf, df = walk
    np.testing.assert_allclose(_values(with_indicators(df, {"x": (name, params)}), "x"),
                               want(pdf), rtol=1e-9)


def test_rsi_macd_atr_adx(walk):
    pdf, df = walk
    out = with_indicators(df, {"rsi": ("RSI", {}), "m": ("MACD", {}), "atr": ("ATR", {}), "a": ("ADX", {})})

    def wilder(s):
        return s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()

    d = pdf.close.diff()
    rsi = 100 - 100 / (1 + wilder(d.clip(lower=0)) / wilder((-d).clip(lower=0)))
    np.testing.assert_allclose(_values(out, "rsi"), rsi, rtol=1e-9)
    line = pdf.close.ewm(span=12, adjust=False).mean() - pdf.close.ewm(span=26, adjust=False).mean()
    line[:25] = np.nan
    signal = line.ewm(span=9, adjust=False, min_periods=9).mean()
    np.testing.assert_allclose(_values(out, "m_signal"), signal, rtol=1e-8)
    np.testing.assert_allclose(_values(out, "m_hist"), line - signal, rtol=1e-6, atol=1e-9)
    pc = pdf.close.shift()
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - pc).abs(), (pdf.low - pc).abs()], axis=1).max(axis=1)
    np.testing.assert_allclose(_values(out, "atr"), wilder(tr), rtol=1e-9)
    up, dn = pdf.high.diff(), -pdf.low.diff()
    pdm = up.where((up > dn) & (up > 0), 0.0).where(up.notna())
    mdm = dn.where((dn > up) & (dn > 0), 0.0).where(up.notna())
    pdi, mdi = 100 * wilder(pdm) / wilder(tr), 100 * wilder(mdm) / wilder(tr)
    adx = wilder(100 * (pdi - mdi).abs() / (pdi + mdi))
    np.testing.assert_allclose(_values(out, "a_adx"), adx, rtol=1e-9)


def test_flat_series_has_rsi_100_and_no_stochastic(make_bars):
    out = with_indicators(make_bars({"000010": [(10, 10, 10, 10)] * 40}),
                          {"r": ("RSI", {}), "s": ("STOCH", {})})
    assert _values(out, "r")[-1] == 100.0
    assert np.isnan(_values(out, "s_k")).all()


def test_bad_parameters(make_bars):
    bars = make_bars({"000010": [(1, 2, 1, 2)]})
    for spec in [("SMA", {"period": 0}), ("SMA", {"period": 2.5}), ("SMA", {"length": 3}), ("NONE", {})]:
        with pytest.raises(ValueError):
            with_indicators(bars, {"x": spec})


def test_registry():
    assert len(REGISTRY) == 16 and {s["name"] for s in spec_list()} == set(REGISTRY)


def test_one_exchange_for_all_window_indicators(make_bars):
    out = with_indicators(make_bars({"000010": [(1, 2, 1, 2)] * 5}),
                          {"a": ("SMA", {}), "b": ("BBANDS", {}), "s": ("STOCH", {}), "d": ("DONCHIAN", {})})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_halted_bars_are_left_out_of_chart_indicators(make_bars):
    bars = make_bars({"000010": [(c, c, c, c) for c in (10, 20, 30, 40)]}, halted={("000010", 1)})
    out = halted_free(bars, {"m": ("SMA", {"period": 2})})
    np.testing.assert_allclose(_values(out, "m"), [np.nan, np.nan, 20, 35])


def test_five_bar_predicates(spark):
    rows = [("A", f"2026-01-0{d}", o, h, l, c) for d, o, h, l, c in [
        (2, 100., 103., 99., 102.), (5, 102., 104., 100., 101.), (6, 101., 102., 97., 98.),
        (7, 99., 101., 95., 100.), (8, 105., 108., 104., 107.)]]
    df = spark.createDataFrame(rows, "code string, date string, open double, high double, low double, close double")

    def run(p):
        return [r.p for r in df.withColumn("p", p).orderBy("date").collect()]

    assert run(P.cross_above(F.col("close"), 100.5)) == [False, False, False, False, True]
    assert run(P.cross_below(F.col("close"), 100.5)) == [False, False, True, False, False]
    unknown = P.compare(F.lit(None).cast("double"), ">", 1.0)
    assert run(unknown) == [False] * 5 and run(P.negate(unknown)) == [True] * 5
    assert run(P.compare(F.lit(None).cast("double"), "!=", 1.0)) == [False] * 5
    assert run(P.all_of()) == [True] * 5


def test_split_is_adjusted_and_issue_is_not(spark):
    def frame(rows):
        df = spark.createDataFrame([("A", f"2024-01-0{i + 1}", *map(float, r)) for i, r in enumerate(rows)],
                                   "code string, date string, open double, high double, low double, close double, volume double, stocks double")
        return df.withColumn("halted", halted())

    split = frame([(2650000, 2660000, 2640000, 2650000, 10, 100), (0, 0, 0, 2650000, 0, 100),
                   (53000, 53900, 51800, 51900, 500, 5000)])
    out = A.adjust_prices(split).orderBy("date").collect()
    assert [r.close for r in out] == pytest.approx([53000, 53000, 51900])
    assert out[1].open == 0 and [r.volume for r in out] == [10, 0, 500]
    issue = frame([(1000, 1000, 1000, 1000, 1, 100), (980, 980, 980, 980, 1, 200)])
    assert [r.close for r in A.adjust_prices(issue).orderBy("date").collect()] == [1000, 980]
    c = A.adjustment_counters(issue).first()
    assert (c.candidates, c.events, c.skipped_not_split) == (1, 0, 1)


def test_recursive_means_keep_small_fold_states(spark):
    """A fold copies its state at every bar, so a state never holds more than one portion."""
    from barloom.functions import indicators as I

    assert I._CHUNK <= 64
    sql = I._fold("x", I.Ewm("x", 0.5))
    assert "done" not in sql and len(re.findall(r"CAST\(array\(\)", sql)) == 1
    n = 5 * I._CHUNK + 3
    xs = [None if i % 7 == 3 or i < 2 else float(i * i % 101) for i in range(n)]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    bars = spark.createDataFrame([("a", d, x) for d, x in zip(days, xs)], "code string, date date, x double")
    got = [r.y for r in I.with_ewm(bars, {"y": I.Ewm("x", 0.25, 3)}).orderBy("date").collect()]
    y, w, known, want = None, 1.0, 0, []
    for x in xs:
        if x is None:
            w = w * 0.75 if y is not None else 1.0
        else:
            y = x if y is None else (w * 0.75 * y + 0.25 * x) / (w * 0.75 + 0.25)
            w, known = 1.0, known + 1
        want.append(y if known >= 3 else None)
    assert got == want


ALL = {"sma": ("SMA", {"period": 3}), "ema": ("EMA", {"period": 4, "source": "hl2"}), "wma": ("WMA", {"period": 5}),
       "bb": ("BBANDS", {"period": 4}), "rsi": ("RSI", {"period": 3}),
       "macd": ("MACD", {"fast": 2, "slow": 5, "signal": 3}), "st": ("STOCH", {"k": 4, "d": 2}),
       "st1": ("STOCH", {"k": 3, "smooth": 1}), "atr": ("ATR", {"period": 3}), "adx": ("ADX", {"period": 3}),
       "cci": ("CCI", {"period": 4}), "obv": ("OBV", {}), "vwap": ("VWAP", {}),
       "vwm": ("VWAP", {"anchor": "month"}), "vww": ("VWAP", {"anchor": "week"}),
       "env": ("ENVELOPE", {"period": 4, "source": "volume"}), "hi": ("HIGHEST", {"period": 6}),
       "lo": ("LOWEST", {"period": 7, "source": "low"}), "dc": ("DONCHIAN", {"period": 5})}


def _rough_bars(spark, halts: bool):
    """Symbols of 1 to 150 bars with flat stretches; with ``halts`` also unknown prices and dates, NaN,
    zero prices and a symbol without a code."""
    rng, rows = np.random.default_rng(3), []
    for k, n in enumerate([1, 2, 40, 150, 7, 90, 3, 64]):
        close = np.round(1000 + np.cumsum(rng.integers(-3, 4, n)) * 0.01, 2)
        for i in range(n):
            c = float(close[i])
            o, h, l, v = c + 0.01, c + float(rng.integers(0, 3)) / 100, c - float(rng.integers(0, 3)) / 100, float(rng.integers(0, 5))
            if i % 50 > 35:
                o = h = l = c = 1000.0
            if halts and rng.random() < 0.15:
                o, h, l, c, v = [(None, h, l, c, v), (o, h, l, None, v), (0.0, 0.0, 0.0, c, 0.0),
                                 (o, None, l, c, None), (o, h, None, c, float("nan"))][rng.integers(0, 5)]
            if halts and k == 5 and i == 60:
                c = float("nan")
            day = None if halts and i == 0 and k % 2 else dt.date(2024, 1, 1) + dt.timedelta(days=i)
            rows.append((None if halts and k == 3 else f"{k:06d}", day, o, h, l, c, v, i))
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "code string, date date, open double, high double, "
                                 "low double, close double, volume double, i int").repartition(3)


def _sorted(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("halts", [False, True])
def test_series_equal_the_column_forms(spark, monkeypatch, halts):
    """Bit for bit, also where symbols meet the end of a portion of rows."""
    from barloom.functions import indicators as I
    from barloom.functions import series

    bars = _rough_bars(spark, halts).cache()
    want = _sorted(I._by_columns(bars, {a: (REGISTRY[n], {**REGISTRY[n].params, **p}) for a, (n, p) in ALL.items()}))
    for rows in (series._ROWS, 20):
        monkeypatch.setattr(series, "_ROWS", rows)
        with monkeypatch.context() as m:
            m.setattr(I, "_by_columns", None)
            out = with_indicators(bars, ALL)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000 if rows > 20 else 8)
        try:
            assert _sorted(out) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_indicators_take_one_pass_over_sorted_bars(make_bars):
    """Not an array of all bars per symbol and three rounds of windows and sorts."""
    from barloom.plans.indicator_queries import ALL_INDICATORS

    out = with_indicators(make_bars({"000010": [(1, 2, 1, 2)] * 5}), ALL_INDICATORS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(x) for x in ("Exchange hashpartitioning", "+- Sort", "MapInArrow", "collect_list", "Window")] \
        == [1, 1, 1, 0, 0]


@pytest.mark.parametrize("digits", [0, 2, 5])
def test_digits_are_those_of_round(spark, digits):
    xs = [0.5, 1.5, 2.5, -0.5, 0.125, 1.005, 2.675, -0.001, 1e-9, 1050.000525, 1050.0005250000001, 0.285, 1e12 + 0.125,
          -1e300, float("nan"), float("inf"), None, 1.0000050000000001, 999.999995, 2.5e-6, 12345.678915, -7.0, 0.0]
    rng = np.random.default_rng(5)
    xs += [*(rng.integers(-10 ** 9, 10 ** 9, 400) / 2000 * 1.05), *rng.normal(0, 1e4, 400)]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(len(xs))]
    bars = spark.createDataFrame([("a", d, None if x is None else float(x)) for d, x in zip(days, xs)],
                                 "code string, date date, close double")
    # the first mean of a symbol is its value
    bars = bars.withColumn("code", F.date_format("date", "yyyyMMdd"))
    got = with_indicators(bars, {"x": ("EMA", {"period": 1})}, digits).withColumn("y", F.round("close", digits))
    rows = got.collect()
    assert len(rows) == len(xs) and [repr(r.x) for r in rows] == [repr(r.y) for r in rows]
    assert sum(r.x is None for r in rows) == 1


def test_series_take_other_codes_inputs_and_indicators(spark, make_bars, monkeypatch):
    path = [(c, c + 1, c - 1, c) for c in (10.0, 11.0, 9.0, 12.0, 13.0, 12.0)]
    bars = make_bars({"000010": path, "000020": path[::-1]}, halted={("000010", 1)})
    wanted = {"e": ("EMA", {"period": 2}), "h": ("HIGHEST", {"period": 2})}
    out = halted_free(bars, wanted)   # its code is a struct
    live = {(r.code, r.date): (r.e, r.h) for r in with_indicators(bars.where("NOT halted"), wanted).collect()}
    rows = out.collect()
    assert sum(r.halted for r in rows) == 1
    assert all((r.e, r.h) == ((None, None) if r.halted else live[r.code, r.date]) for r in rows)
    # whole numbers keep the types of the column forms
    whole = bars.withColumns({c: F.col(c).cast("bigint") for c in ("high", "low", "close", "volume")})
    both = with_indicators(whole, {**wanted, "o": ("OBV", {})})
    assert dict(both.dtypes)["h"] == "bigint" and dict(both.dtypes)["e"] == "double"
    same = with_indicators(bars, wanted)
    assert sorted((r.code, r.date, r.e) for r in both.collect() if r.e) == sorted(
        (r.code, r.date, r.e) for r in same.collect() if r.e)
    # an indicator that was added has its column form alone
    monkeypatch.setitem(REGISTRY, "TWICE", Indicator({}, (), lambda a, p: [{a: F.col("close") * 2.0}]))
    mixed = with_indicators(bars, {"t": ("TWICE", {}), **wanted}, 1)
    assert mixed.columns[-3:] == ["t", "e", "h"] and all(r.t == 2 * r.close for r in mixed.collect())
