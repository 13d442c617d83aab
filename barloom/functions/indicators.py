"""Technical indicators as columns over a bar table.

``with_indicators(bars, {"ma20": ("SMA", {"period": 20}), ...})`` adds one column per
single-field indicator (named by its alias) and ``alias_field`` columns otherwise.

An indicator is a list of steps.  A step is a dict of window columns or a dict of
exponentially weighted means (``Ewm``).  The steps of all requested indicators run side by
side: window columns of the same step share one projection over the same
``partitionBy(code).orderBy(date)`` spec, and all recursive means of a step share one pass.
However many indicators are asked for, there is one exchange on ``code``.

Folds and wide frames cost a lot per bar in Spark's expressions.  So where recursive means are
asked for and all inputs are doubles, the indicators that have a form in ``series`` are
computed by it, in one pass over the sorted bars, with the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import series
from .columns import BAR_FIELDS, finite, source, symbol_window
from .series import CCI_SCALE

# Anchors at which the volume-weighted price restarts.
VWAP_ANCHORS = {"session": "day", "day": "day", "daily": "day", "week": "week",
                "month": "month", "quarter": "quarter", "year": "year"}

# Bars folded into one output array before a new one is started: a step copies that array.
_CHUNK = 32


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean: y = (1-alpha) y + alpha x, shown from ``min_periods``."""

    column: str
    alpha: float
    min_periods: int = 1


@dataclass(frozen=True)
class Indicator:
    """``build`` gives the steps of the column form; ``series``, if there is one, is the form in
    ``series`` and ``inputs`` are the prices it reads besides its parameter ``source``."""

    params: dict
    fields: tuple[str, ...]
    build: Callable
    help: str = ""
    tags: tuple = field(default=())
    series: Callable | None = None
    inputs: tuple[str, ...] = ()


def rolling_frame(n: int, w=None):
    return (w if w is not None else symbol_window()).rowsBetween(-(n - 1), 0)


def rolling(agg: Callable[[Column], Column], c: Column | str, n: int, w=None) -> Column:
    """Rolling aggregate that is NULL until ``n`` known values fill the window."""
    x = F.col(c) if isinstance(c, str) else c
    f = rolling_frame(n, w)
    return F.when(F.count(x).over(f) == n, agg(x).over(f))


def sma(c, n: int, w=None) -> Column:
    return rolling(F.avg, c, n, w)


def _period(p: dict, key: str = "period") -> int:
    n = p[key]
    if isinstance(n, bool) or int(n) != n or int(n) < 1:
        raise ValueError(f"{key} must be an integer >= 1, got {n!r}")
    return int(n)


def true_range(w=None) -> Column:
    pc = F.lag("close").over(w if w is not None else symbol_window())
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))


def _sma(a, p):
    return [{a: sma(source(p["source"]), _period(p))}]


def _ema(a, p):
    n = _period(p)
    return [{f"_{a}_x": source(p["source"])}, {a: Ewm(f"_{a}_x", 2.0 / (n + 1), n)}]


def _wma(a, p):
    """Linear weights from two running sums, S = sum(x) and T = sum(i x), i the bar number:
    the weight of bar i in a window ending at t is i - (t - n), so the numerator is
    T_window - (t - n) S_window.  One frame instead of n lags."""
    n, x = _period(p), source(p["source"])
    f = rolling_frame(n)
    i = f"_{a}_i"
    num = F.sum(x * F.col(i)).over(f) - (F.col(i) - n) * F.sum(x).over(f)
    return [{i: F.row_number().over(symbol_window()).cast("double")},
            {a: F.when(F.count(x).over(f) == n, num / (n * (n + 1) / 2.0))}]


def _bbands(a, p):
    n, x, k = _period(p), source(p["source"]), float(p["stddev"])
    mid, sd = sma(x, n), rolling(F.stddev_pop, x, n)
    return [{f"{a}_middle": mid, f"{a}_upper": mid + k * sd, f"{a}_lower": mid - k * sd,
             f"{a}_width": 2 * k * sd}]


def _rsi(a, p):
    n, x = _period(p), source(p["source"])
    d = x - F.lag(x).over(symbol_window())
    up, down = f"_{a}_up", f"_{a}_dn"
    zero = F.lit(0.0)
    rs = F.try_divide(F.col(f"{up}_m"), F.col(f"{down}_m"))
    return [
        {up: F.when(d.isNotNull(), F.greatest(d, zero)),
         down: F.when(d.isNotNull(), F.greatest(-d, zero))},
        {f"{up}_m": Ewm(up, 1.0 / n, n), f"{down}_m": Ewm(down, 1.0 / n, n)},
        {a: F.when(F.col(f"{down}_m") == 0, F.when(F.col(f"{up}_m").isNotNull(), F.lit(100.0)))
            .otherwise(100.0 - 100.0 / (1.0 + rs))},
    ]


def _macd(a, p):
    fast, slow, sig = _period(p, "fast"), _period(p, "slow"), _period(p, "signal")
    x, i = f"_{a}_x", f"_{a}_i"
    line = F.when(F.col(i) >= slow, F.col(f"_{a}_f") - F.col(f"_{a}_s"))
    return [
        {x: source(p["source"]), i: F.row_number().over(symbol_window())},
        {f"_{a}_f": Ewm(x, 2.0 / (fast + 1)), f"_{a}_s": Ewm(x, 2.0 / (slow + 1))},
        {f"{a}_macd": line},
        {f"{a}_signal": Ewm(f"{a}_macd", 2.0 / (sig + 1), sig)},
        {f"{a}_hist": F.col(f"{a}_macd") - F.col(f"{a}_signal")},
    ]


def _stoch(a, p):
    k, d, smooth = _period(p, "k"), _period(p, "d"), _period(p, "smooth")
    hh, ll = rolling(F.max, "high", k), rolling(F.min, "low", k)
    raw, kk = f"{a}_raw", f"{a}_k"
    return [{raw: 100.0 * F.try_divide(F.col("close") - ll, hh - ll)},
            {kk: sma(raw, smooth) if smooth > 1 else F.col(raw)},
            {f"{a}_d": sma(kk, d)}]


def _atr(a, p):
    n = _period(p)
    return [{f"_{a}_tr": true_range()}, {a: Ewm(f"_{a}_tr", 1.0 / n, n)}]


def _adx(a, p):
    n, w = _period(p), symbol_window()
    up = F.col("high") - F.lag("high").over(w)
    dn = F.lag("low").over(w) - F.col("low")
    known_up, known_dn = F.coalesce(up, F.lit(0.0)), F.coalesce(dn, F.lit(0.0))
    first = F.lag("date").over(w).isNull()
    tr, pm, mm, dx = (f"_{a}_{s}" for s in ("tr", "pm", "mm", "dx"))
    pdi, mdi = F.col(f"{a}_pdi"), F.col(f"{a}_mdi")
    return [
        {tr: true_range(),
         pm: F.when(~first, F.when((up > dn) & (known_up > 0), up).otherwise(0.0)),
         mm: F.when(~first, F.when((dn > up) & (known_dn > 0), dn).otherwise(0.0))},
        {f"{tr}_m": Ewm(tr, 1.0 / n, n), f"{pm}_m": Ewm(pm, 1.0 / n, n),
         f"{mm}_m": Ewm(mm, 1.0 / n, n)},
        {f"{a}_pdi": 100.0 * F.try_divide(F.col(f"{pm}_m"), F.col(f"{tr}_m")),
         f"{a}_mdi": 100.0 * F.try_divide(F.col(f"{mm}_m"), F.col(f"{tr}_m"))},
        {dx: 100.0 * F.try_divide(F.abs(pdi - mdi), pdi + mdi)},
        {f"{a}_adx": Ewm(dx, 1.0 / n, n)},
    ]


def _cci(a, p):
    n, tp, m = _period(p), f"_{a}_tp", f"_{a}_mean"
    f = rolling_frame(n)
    spread = F.aggregate(F.collect_list(tp).over(f), F.lit(0.0),
                         lambda s, x: s + F.abs(x - F.col(m))) / n
    return [{tp: source("hlc3")}, {m: sma(tp, n)}, {f"_{a}_mad": spread},
            {a: F.try_divide(F.col(tp) - F.col(m), CCI_SCALE * F.col(f"_{a}_mad"))}]


def _obv(a, p):
    w = symbol_window()
    step = F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")
    return [{f"_{a}_step": F.coalesce(step, F.lit(0.0))},
            {a: F.sum(f"_{a}_step").over(w.rowsBetween(Window.unboundedPreceding, 0))}]


def _vwap(a, p):
    unit = VWAP_ANCHORS.get(str(p["anchor"]).lower())
    keys = ["code"] + ([F.date_trunc(unit, "date")] if unit else [])
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("volume")
    return [{a: F.try_divide(F.sum(source("hlc3") * v).over(w), F.sum(v).over(w))}]


def _envelope(a, p):
    n, pct = _period(p), float(p["pct"]) / 100.0
    mid = sma(source(p["source"]), n)
    return [{f"{a}_upper": mid * (1 + pct), f"{a}_middle": mid, f"{a}_lower": mid * (1 - pct)}]


def _highest(a, p):
    return [{a: rolling(F.max, source(p["source"]), _period(p))}]


def _lowest(a, p):
    return [{a: rolling(F.min, source(p["source"]), _period(p))}]


def _donchian(a, p):
    n = _period(p)
    up, lo = rolling(F.max, "high", n), rolling(F.min, "low", n)
    return [{f"{a}_upper": up, f"{a}_lower": lo, f"{a}_middle": (up + lo) / 2}]


_CLOSE = {"source": "close"}
_HLC = ("high", "low", "close")
_PERIODS = ("period", "fast", "slow", "signal", "k", "d", "smooth")

REGISTRY: dict[str, Indicator] = {
    "SMA": Indicator({"period": 20, **_CLOSE}, (), _sma, "simple moving average", series=series.sma),
    "EMA": Indicator({"period": 20, **_CLOSE}, (), _ema, "exponential moving average",
                     series=series.ema),
    "WMA": Indicator({"period": 20, **_CLOSE}, (), _wma, "linearly weighted moving average",
                     series=series.wma),
    "BBANDS": Indicator({"period": 20, "stddev": 2.0, **_CLOSE},
                        ("middle", "upper", "lower", "width"), _bbands, "Bollinger bands",
                        series=series.bbands),
    "RSI": Indicator({"period": 14, **_CLOSE}, (), _rsi, "relative strength index",
                     series=series.rsi),
    "MACD": Indicator({"fast": 12, "slow": 26, "signal": 9, **_CLOSE},
                      ("macd", "signal", "hist"), _macd, "moving average convergence",
                      series=series.macd),
    "STOCH": Indicator({"k": 14, "d": 3, "smooth": 3}, ("k", "d", "raw"), _stoch, "stochastic",
                       series=series.stoch, inputs=_HLC),
    "ATR": Indicator({"period": 14}, (), _atr, "average true range", series=series.atr, inputs=_HLC),
    "ADX": Indicator({"period": 14}, ("adx", "pdi", "mdi"), _adx, "directional movement",
                     series=series.adx, inputs=_HLC),
    "CCI": Indicator({"period": 20}, (), _cci, "commodity channel index", series=series.cci,
                     inputs=("hlc3",)),
    "OBV": Indicator({}, (), _obv, "on-balance volume", series=series.obv,
                     inputs=("close", "volume")),
    "VWAP": Indicator({"anchor": "all"}, (), _vwap, "volume-weighted average price",
                      series=series.vwap, inputs=("hlc3", "volume")),
    "ENVELOPE": Indicator({"period": 20, "pct": 5.0, **_CLOSE},
                          ("upper", "middle", "lower"), _envelope, "percentage envelope",
                          series=series.envelope),
    "HIGHEST": Indicator({"period": 252, **_CLOSE}, (), _highest, "rolling maximum",
                         series=series.highest),
    "LOWEST": Indicator({"period": 252, **_CLOSE}, (), _lowest, "rolling minimum",
                        series=series.lowest),
    "DONCHIAN": Indicator({"period": 20}, ("upper", "lower", "middle"), _donchian,
                          "price channel", series=series.donchian, inputs=("high", "low")),
}


def register(name: str, indicator: Indicator) -> None:
    """Add an indicator; its ``build(alias, params)`` returns the list of steps."""
    REGISTRY[name.upper()] = indicator


def spec_list() -> list[dict]:
    return [{"name": k, "params": dict(v.params), "fields": list(v.fields), "help": v.help}
            for k, v in REGISTRY.items()]


def output_columns(alias: str, name: str) -> list[str]:
    return _fields(alias, REGISTRY[name.upper()])


def _fields(alias: str, spec: Indicator) -> list[str]:
    return [f"{alias}_{f}" for f in spec.fields] if spec.fields else [alias]


def _fold(column: str, spec: Ewm) -> str:
    """SQL expression: smoothed values of ``_chunks``, the date-sorted bar structs in portions.

    The state keeps the mean, the weight it still carries (an unknown value repeats the mean
    but lets its weight decay) and the number of known values.  ``aggregate`` copies its state
    at every element, so a state must stay small: a first fold keeps the state before each
    portion, a second one lists the values of a portion.  A step appends the value before it,
    so nothing has to be bound twice; the last one is appended at the end of the portion and
    the first, which belongs to the portion before, is cut.
    """
    q, alpha = f"{1.0 - spec.alpha!r}D", f"{spec.alpha!r}D"
    x, shown = f"x.`{column}`", f"IF(s.n >= {spec.min_periods}, s.y, NULL)"
    advance = f"""'y', CASE WHEN {x} IS NULL THEN s.y WHEN s.y IS NULL THEN {x}
                  ELSE (s.w * {q} * s.y + {alpha} * {x}) / (s.w * {q} + {alpha}) END,
        'w', CASE WHEN {x} IS NULL AND s.y IS NOT NULL THEN s.w * {q} ELSE 1D END,
        'n', IF({x} IS NULL, s.n, s.n + 1)"""
    states = f"""aggregate(_chunks, array(named_struct('y', CAST(NULL AS DOUBLE), 'w', 1D, 'n', 0)),
        (acc, c) -> concat(acc, array(aggregate(c, element_at(acc, -1),
                                                (s, x) -> named_struct({advance})))),
        acc -> slice(acc, 1, size(_chunks)))"""
    return f"""flatten(zip_with(_chunks, {states}, (c, at) -> aggregate(c,
        named_struct('y', at.y, 'w', at.w, 'n', at.n, 'out', CAST(array() AS ARRAY<DOUBLE>)),
        (s, x) -> named_struct({advance}, 'out', concat(s.out, array({shown}))),
        s -> slice(concat(s.out, array({shown})), 2, size(c)))))"""


def with_ewm(bars: DataFrame, specs: dict[str, Ewm]) -> DataFrame:
    """Add exponentially weighted means; one pass per symbol for all of them.

    The bars of a symbol (bounded by the trading days) are gathered into one date-sorted
    array and folded inside the JVM, then unrolled again.  The folds see the smoothed columns
    alone, in portions of ``_CHUNK`` bars.
    """
    rest = [c for c in bars.columns if c not in ("code", "date")]
    packed = bars.groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct("date", *rest))).alias("_rows"))
    inputs = ", ".join(f"'{c}', x.`{c}`" for c in dict.fromkeys(s.column for s in specs.values()))
    packed = packed.selectExpr("code", "_rows", f"""transform(sequence(1, size(_rows), {_CHUNK}),
        first -> transform(slice(_rows, first, {_CHUNK}), x -> named_struct({inputs}))) AS _chunks""")
    folded = packed.selectExpr("code", "_rows", *[f"{_fold(s.column, s)} AS `{name}`"
                                                  for name, s in specs.items()])
    names = ", ".join(f"`{n}`" for n in specs)
    pairs = folded.selectExpr("code", f"explode(arrays_zip(_rows, {names})) AS _z")
    return pairs.selectExpr("code", "_z._rows.*", *[f"_z.`{n}`" for n in specs])


def _by_series(bars: DataFrame, wanted: dict[str, tuple[Indicator, dict]],
               digits: int | None) -> DataFrame | None:
    """The columns of ``wanted`` by ``series``, in one exchange and one sort.  None where an input
    is no double: the types of the results then follow the column forms."""
    asked, prices, periods = [], {}, {}
    for alias, (spec, params) in wanted.items():
        p = {**params, **{k: _period(params, k) for k in _PERIODS if k in params}}
        p["inputs"] = {}
        for n in [p["source"]] if "source" in p else spec.inputs:
            own = n.lower() in BAR_FIELDS and n.lower() in bars.columns
            p["inputs"][n] = n.lower() if own else f"_in_{n.lower()}"
            prices[p["inputs"][n]] = source(n)
        if "anchor" in p:
            unit = VWAP_ANCHORS.get(str(p["anchor"]).lower())
            p["group"] = f"_by_{unit}" if unit else None
            periods |= {f"_by_{unit}": F.date_trunc(unit, "date")} if unit else {}
        asked.append((alias, spec.series, p))
    inputs = bars.select(*[c.alias(n) for n, c in prices.items()])
    if (any(not isinstance(f.dataType, T.DoubleType) for f in inputs.schema.fields)
            or not {"code", "date"} <= set(bars.columns)):
        return None
    added = [c for a, (spec, _) in wanted.items() for c in _fields(a, spec)]
    kept = [f for f in bars.schema.fields if f.name not in added]
    marked = digits is not None and 0 <= digits <= 22 and len(added) < 64  # a bit each in a long
    plan = series.Plan(asked, list(prices), list(periods), [f.name for f in kept], added,
                       digits if marked else None)
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in added],
                           T.StructField("_unsure", T.LongType())])
    derived = {n: c for n, c in prices.items() if n not in bars.columns}
    out = (bars.withColumns({**derived, **periods}).repartition("code")
           .sortWithinPartitions("code", "date").mapInArrow(plan, schema))
    if marked:
        out = out.withColumns({c: F.when(F.getbit("_unsure", F.lit(i)) == 1, F.round(c, digits))
                               .otherwise(F.col(c)) for i, c in enumerate(added)})
    elif digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in added})
    return out.drop("_unsure")


def _by_columns(bars: DataFrame, wanted: dict[str, tuple[Indicator, dict]]) -> DataFrame:
    """The columns of ``wanted`` by the steps of their column forms."""
    windows: dict[int, dict[str, Column]] = {}
    means: dict[int, dict[str, Ewm]] = {}
    for alias, (spec, params) in wanted.items():
        level = -1
        for step in spec.build(alias, params):
            recursive = any(isinstance(v, Ewm) for v in step.values())
            # even levels hold window columns, odd levels hold recursive means
            level += 1 if recursive == bool((level + 1) % 2) else 2
            (means if recursive else windows).setdefault(level, {}).update(step)
    out = bars
    for level in sorted({*windows, *means}):
        out = (with_ewm(out, means[level]) if level in means
               else out.withColumns(windows[level]))
    return out.select(*bars.columns, *[c for a, (spec, _) in wanted.items() for c in _fields(a, spec)])


def with_indicators(bars: DataFrame, wanted: dict[str, tuple[str, dict]],
                    digits: int | None = None) -> DataFrame:
    """Add the columns of every requested indicator; helper columns are dropped.

    With ``digits`` the added columns are rounded as by ``F.round``.
    """
    found: dict[str, tuple[Indicator, dict]] = {}
    for alias, (name, params) in wanted.items():
        spec = REGISTRY.get(name.upper())
        if spec is None:
            raise ValueError(f"unknown indicator: {name}")
        unknown = set(params) - set(spec.params)
        if unknown:
            raise ValueError(f"{name} has no parameter {sorted(unknown)}")
        found[alias] = spec, {**spec.params, **params}
    recursive = any(isinstance(v, Ewm) for a, (spec, p) in found.items()
                    for step in spec.build(a, p) for v in step.values())
    in_series = {a: x for a, x in found.items() if recursive and x[0].series is not None}
    out = _by_series(bars, in_series, digits) if in_series else None
    if out is None:
        in_series, out = {}, bars
    rest = {a: x for a, x in found.items() if a not in in_series}
    if rest:
        out = _by_columns(out, rest)
        if digits is not None:
            out = out.withColumns({c: F.round(c, digits) for a, (spec, _) in rest.items()
                                   for c in _fields(a, spec)})
    return out.select(*bars.columns, *[c for a, (spec, _) in found.items() for c in _fields(a, spec)])


def halted_free(bars: DataFrame, wanted: dict[str, tuple[str, dict]]) -> DataFrame:
    """Indicators computed without halted bars, NULL on the halted ones (chart view).

    One scan and one exchange: a symbol's live and halted bars are series of their own while the
    indicators run, so a frame over live bars never sees a halted one.
    """
    series = F.struct("code", F.coalesce("halted", F.lit(False)).alias("halted"))
    out = with_indicators(bars.withColumn("code", series), wanted)
    added = [c for a, (n, _) in wanted.items() for c in output_columns(a, n)]
    return out.select(
        *[F.col("code.code").alias("code") if c == "code" else F.col(f"`{c}`") for c in bars.columns],
        *[F.when(~F.col("code.halted"), F.col(f"`{c}`")).alias(c) for c in added])
