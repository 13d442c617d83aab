"""The sixteen indicators over sorted bars, computed by numpy inside tasks.

A task walks its bars, sorted by symbol and date, some whole symbols at a time.  Rolling
values add the frames of all rows at once, from the oldest bar to the newest as Spark does;
recursive values step through the bars of all these symbols side by side.  The arithmetic and
its order are those of the column forms in ``indicators``, so both give the same values.

An indicator here returns its fields.  One that needs recursions is a generator: it yields those
it needs next and is sent their results, so the recursions of all indicators share a walk.  A
series is a pair of numbers and of marks where they are known (not NULL); unknown numbers mean
nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value

# tasks get the functions of this module with the query: executors need not have the library
register_pickle_by_value(sys.modules[__name__])

# Rows of whole symbols that are computed at once.
_ROWS = 65_536
# Fixed value: scale of the commodity channel index.
CCI_SCALE = 0.015

Series = tuple[np.ndarray, np.ndarray]


@dataclass
class Recursion:
    """Exponentially weighted mean of ``x`` as ``indicators.Ewm``, or its running total.

    ``group`` names the column of periods at which a total restarts.
    """

    x: Series
    alpha: float = 1.0
    min_periods: int = 1
    total: bool = False
    group: str | None = None


class Walk:
    """Rows of whole runs laid out by their place in the run, the longest run first: the rows
    at one place lie together, and the runs that go on are the first of them."""

    def __init__(self, new: np.ndarray):
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(new)))
        self.run = np.cumsum(new) - 1
        self.pos = np.arange(len(new)) - starts[self.run]
        self.starts = starts
        rank = np.empty(len(starts), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(starts))
        longest = int(lengths.max(initial=0))
        going_on = len(starts) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
        self.ends = np.cumsum(going_on)
        self.at = (self.ends - going_on)[self.pos] + rank[self.run]

    def results(self, asked: list[Recursion]) -> list[Series]:
        known, gaps = [], []
        for r in asked:
            seen = np.cumsum(r.x[1])
            known.append(seen - (seen - r.x[1])[self.starts][self.run])
            gaps.append(not r.total and bool((~r.x[1] & (known[-1] > 0)).any()))
        out: list[Series | None] = [None] * len(asked)
        for some in ([i for i, g in enumerate(gaps) if g], [i for i, g in enumerate(gaps) if not g]):
            if some:
                values = self._steps([asked[i] for i in some], [known[i] for i in some], gaps[some[0]])
                for i, y in zip(some, values):
                    out[i] = y[self.at], known[i] >= max(asked[i].min_periods, 1)
        return out

    def _steps(self, asked: list[Recursion], known: list[np.ndarray], gaps: bool) -> np.ndarray:
        """A row of smoothed values for each recursion, laid out by place."""
        shape = len(asked), len(self.at)
        x, out = np.empty(shape), np.empty(shape)
        first, given, lost = np.zeros(shape, bool), np.ones(shape, bool), np.zeros(shape, bool)
        for i, r in enumerate(asked):
            x[i, self.at] = np.where(r.x[1], r.x[0], 0.0)
            if not r.total:  # an unknown value adds nothing to a total
                first[i, self.at] = r.x[1] & (known[i] == 1)
                given[i, self.at] = r.x[1]
                lost[i, self.at] = ~r.x[1] & (known[i] > 0)
        alpha = np.array([[r.alpha] for r in asked])
        q = np.array([[1.0 if r.total else 1.0 - r.alpha] for r in asked])
        whole = np.array([[1.0 if r.total else (1.0 - r.alpha) + r.alpha] for r in asked])
        share = alpha * x
        state = np.zeros((shape[0], int(self.ends[0]) if len(self.ends) else 0))
        weight, start = np.ones_like(state), 0
        for end in self.ends.tolist():
            here, y = slice(start, end), state[:, :end - start]
            if gaps:  # an unknown value keeps the mean and lets its weight decay
                w = weight[:, :end - start]
                decayed = w * q
                new = (decayed * y + share[:, here]) / (decayed + alpha)
                np.copyto(new, x[:, here], where=first[:, here])
                np.copyto(y, new, where=given[:, here])
                np.copyto(w, np.where(lost[:, here], decayed, 1.0))
            else:
                np.multiply(y, q, out=y)
                y += share[:, here]
                y /= whole
                np.copyto(y, x[:, here], where=first[:, here])
            out[:, here] = y
            start = end
        return out


class Bars:
    """Some whole symbols: their input columns as series, and what looks back at earlier bars."""

    def __init__(self, table: pa.RecordBatch, numbers: list[str], groups: list[str]):
        self.symbols = Walk(changes(table["code"]))
        self.pos = self.symbols.pos
        self.dated = _known(table["date"])
        self.columns = {c: (table[c].to_numpy(zero_copy_only=False), _known(table[c])) for c in numbers}
        self.walks = {None: self.symbols}
        for g in groups:
            self.walks[g] = Walk(changes(table["code"]) | changes(table[g]))

    def price(self, p: dict, name: str | None = None) -> Series:
        """The price source ``name``, or the one that the parameters name."""
        return self.columns[p["inputs"][name or p["source"]]]

    def number(self) -> np.ndarray:
        return (self.pos + 1).astype(float)

    def first(self) -> np.ndarray:
        """Bars without a date before them."""
        return ~self._before(self.dated, False)

    def _before(self, a: np.ndarray, none) -> np.ndarray:
        return np.where(self.pos > 0, np.concatenate([[none], a[:-1]]), none)

    def lag(self, s: Series) -> Series:
        return self._before(s[0], np.nan), self._before(s[1], False)

    def full(self, s: Series, n: int) -> np.ndarray:
        """Whether the frame of the last ``n`` bars holds ``n`` known values."""
        seen = np.concatenate([[0], np.cumsum(s[1])])
        out = np.zeros(len(self.pos), bool)
        out[n - 1:] = seen[n:] - seen[:-n] == n
        return out & (self.pos >= n - 1)

    def sma(self, s: Series, n: int) -> Series:
        return total(s[0], n) / float(n), self.full(s, n)

    def highest(self, s: Series, n: int) -> Series:
        return _extreme(s[0], n, np.maximum), self.full(s, n)  # NaN is above all numbers, as in Spark

    def lowest(self, s: Series, n: int) -> Series:
        return _extreme(s[0], n, np.fmin), self.full(s, n)

    def results(self, asked: list[Recursion]) -> list[Series]:
        out: list[Series | None] = [None] * len(asked)
        for g, walk in self.walks.items():
            mine = [i for i, r in enumerate(asked) if r.group == g]
            for i, s in zip(mine, walk.results([asked[i] for i in mine])):
                out[i] = s
        return out


def changes(column: pa.Array) -> np.ndarray:
    """Whether a row is the first or differs from the one before; NULLs are equal."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        known = _known(column)
        differs = known[1:] != known[:-1]
        if pa.types.is_struct(column.type):
            for part in column.flatten():
                differs |= changes(part)[1:]
        else:
            unequal = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
            differs |= unequal.to_numpy(zero_copy_only=False)
        out[1:] = differs
    return out


def _known(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def frames(n: int, *values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The bars of all frames of ``n`` bars, the oldest of each first, then the next, ..."""
    size = len(values[0])
    for k in range(n if size >= n else 0):
        yield tuple(v[k:size - n + 1 + k] for v in values)


def total(values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(values))
    tail = out[n - 1:]
    for (v,) in frames(n, values):
        tail += v
    return out


def _extreme(values: np.ndarray, n: int, join) -> np.ndarray:
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        wider = out.copy()
        wider[step:] = join(out[step:], out[:-step])
        out, width = wider, width + step
    return out


def above(a: Series, b: Series) -> np.ndarray:
    """a > b where both are known; NaN is above all numbers, as in Spark."""
    return a[1] & b[1] & ((a[0] > b[0]) | (np.isnan(a[0]) & ~np.isnan(b[0])))


def greatest(*some: Series) -> Series:
    value, known = some[0]
    for s in some[1:]:
        take = (s[1] & ~known) | above(s, (value, known))
        value, known = np.where(take, s[0], value), known | s[1]
    return value, known


def ratio(a: Series, b: Series) -> Series:
    """``a / b``, unknown for division by zero."""
    return a[0] / b[0], a[1] & b[1] & (b[0] != 0)


def _minus(a: Series, b: Series) -> Series:
    return a[0] - b[0], a[1] & b[1]


def _true_range(b: Bars, p: dict) -> Series:
    last, (h, l) = b.lag(b.price(p, "close")), (b.price(p, "high"), b.price(p, "low"))
    return greatest(_minus(h, l), *[(np.abs(v), k) for v, k in (_minus(h, last), _minus(l, last))])


# ------------------------------------------------------------------------- the indicators
# p: the checked parameters


def sma(b: Bars, p: dict):
    return {"": b.sma(b.price(p), p["period"])}


def ema(b: Bars, p: dict):
    n = p["period"]
    (mean,) = yield [Recursion(b.price(p), 2.0 / (n + 1), n)]
    return {"": mean}


def wma(b: Bars, p: dict):
    n, x, i = p["period"], b.price(p), b.number()
    num = total(x[0] * i, n) - (i - n) * total(x[0], n)
    return {"": (num / (n * (n + 1) / 2.0), b.full(x, n))}


def bbands(b: Bars, p: dict):
    n, x, k = p["period"], b.price(p), float(p["stddev"])
    (mid, known), count = b.sma(x, n), 0.0
    mean, squares = np.zeros(len(mid)), np.zeros(len(mid))
    m, s = mean[n - 1:], squares[n - 1:]
    for (v,) in frames(n, x[0]):
        count += 1.0
        delta = v - m
        part = delta / count
        m += part
        s += delta * (delta - part)
    sd = np.sqrt(squares / float(n))
    return {"middle": (mid, known), "upper": (mid + k * sd, known), "lower": (mid - k * sd, known),
            "width": (2 * k * sd, known)}


def rsi(b: Bars, p: dict):
    n, x = p["period"], b.price(p)
    d, known = _minus(x, b.lag(x))
    up, down = yield [Recursion((np.maximum(d, 0.0), known), 1.0 / n, n),
                      Recursion((np.maximum(-d, 0.0), known), 1.0 / n, n)]
    rs, divided = ratio(up, down)
    never = down[1] & (down[0] == 0)
    return {"": (np.where(never, 100.0, 100.0 - 100.0 / (1.0 + rs)), np.where(never, up[1], divided))}


def macd(b: Bars, p: dict):
    x = b.price(p)
    fast, slow = yield [Recursion(x, 2.0 / (p["fast"] + 1)), Recursion(x, 2.0 / (p["slow"] + 1))]
    value, known = _minus(fast, slow)
    line = value, known & (b.pos + 1 >= p["slow"])
    (signal,) = yield [Recursion(line, 2.0 / (p["signal"] + 1), p["signal"])]
    return {"macd": line, "signal": signal, "hist": _minus(line, signal)}


def stoch(b: Bars, p: dict):
    hh, ll = b.highest(b.price(p, "high"), p["k"]), b.lowest(b.price(p, "low"), p["k"])
    value, known = ratio(_minus(b.price(p, "close"), ll), _minus(hh, ll))
    raw = 100.0 * value, known
    k = b.sma(raw, p["smooth"]) if p["smooth"] > 1 else raw
    return {"raw": raw, "k": k, "d": b.sma(k, p["d"])}


def atr(b: Bars, p: dict):
    (mean,) = yield [Recursion(_true_range(b, p), 1.0 / p["period"], p["period"])]
    return {"": mean}


def adx(b: Bars, p: dict):
    n = p["period"]
    high, low = b.price(p, "high"), b.price(p, "low")
    up, dn = _minus(high, b.lag(high)), _minus(b.lag(low), low)
    zero, later = (np.zeros(len(b.pos)), np.ones(len(b.pos), bool)), ~b.first()
    plus = np.where(above(up, dn) & above(up, zero), up[0], 0.0)
    minus = np.where(above(dn, up) & above(dn, zero), dn[0], 0.0)
    tr, pm, mm = yield [Recursion(_true_range(b, p), 1.0 / n, n), Recursion((plus, later), 1.0 / n, n),
                        Recursion((minus, later), 1.0 / n, n)]
    pdi, mdi = [(100.0 * v, k) for v, k in (ratio(pm, tr), ratio(mm, tr))]
    gap, known = _minus(pdi, mdi)
    dx, divided = ratio((np.abs(gap), known), (pdi[0] + mdi[0], known))
    (mean,) = yield [Recursion((100.0 * dx, divided), 1.0 / n, n)]
    return {"adx": mean, "pdi": pdi, "mdi": mdi}


def cci(b: Bars, p: dict):
    n, tp = p["period"], b.price(p, "hlc3")
    mean, known = b.sma(tp, n)
    spread = np.zeros(len(mean))
    tail = spread[n - 1:]
    for (v,) in frames(n, tp[0]):
        tail += np.abs(v - mean[n - 1:])
    return {"": ratio(_minus(tp, (mean, known)), (CCI_SCALE * (spread / float(n)), known))}


def obv(b: Bars, p: dict):
    close, volume = b.price(p, "close"), b.price(p, "volume")
    d, known = _minus(close, b.lag(close))
    step = np.where(known & volume[1], np.sign(d) * volume[0], 0.0)
    (out,) = yield [Recursion((step, np.ones(len(step), bool)), total=True)]
    return {"": out}


def vwap(b: Bars, p: dict):
    (price, priced), volume = b.price(p, "hlc3"), b.price(p, "volume")
    traded = price * volume[0], priced & volume[1]
    money, volumes = yield [Recursion(s, total=True, group=p["group"]) for s in (traded, volume)]
    return {"": ratio(money, volumes)}


def envelope(b: Bars, p: dict):
    mid, known = b.sma(b.price(p), p["period"])
    pct = float(p["pct"]) / 100.0
    return {"upper": (mid * (1 + pct), known), "middle": (mid, known), "lower": (mid * (1 - pct), known)}


def highest(b: Bars, p: dict):
    return {"": b.highest(b.price(p), p["period"])}


def lowest(b: Bars, p: dict):
    return {"": b.lowest(b.price(p), p["period"])}


def donchian(b: Bars, p: dict):
    n = p["period"]
    (up, known), (lo, low_known) = b.highest(b.price(p, "high"), n), b.lowest(b.price(p, "low"), n)
    return {"upper": (up, known), "lower": (lo, low_known), "middle": ((up + lo) / 2, known & low_known)}


# ------------------------------------------------------------------------------ the task


@dataclass
class Plan:
    """What a task computes: (alias, indicator, parameters), the input columns it reads, the
    columns of periods, those it passes on, the fields it adds and their digits."""

    asked: list[tuple[str, Callable, dict]]
    numbers: list[str]
    groups: list[str]
    kept: list[str]
    added: list[str]
    digits: int | None = None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, _ROWS
        for batch in _then_none(batches):
            if batch is not None:
                held.append(batch)
                rows += batch.num_rows
            if rows == 0 or (batch is not None and rows < enough):
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = rows if batch is None else int(np.flatnonzero(changes(table["code"]))[-1])
            if cut:
                yield self.answers(table.slice(0, cut))
            held, rows = [table.slice(cut)], rows - cut
            enough = max(_ROWS, 2 * rows)  # a longer symbol is not looked at with every batch

    def answers(self, table: pa.RecordBatch) -> pa.RecordBatch:
        b, found = Bars(table, self.numbers, self.groups), {}
        with np.errstate(all="ignore"):
            running = {a: kind(b, p) for a, kind, p in self.asked}
            sent = dict.fromkeys(running)
            while running:
                asked = {}
                for a, g in list(running.items()):
                    try:
                        fields = g if isinstance(g, dict) else None
                        if fields is None:
                            asked[a] = g.send(sent[a])
                    except StopIteration as end:
                        fields = end.value
                    if fields is not None:
                        found.update({f"{a}_{f}" if f else a: s for f, s in fields.items()})
                        del running[a]
                results = iter(b.results([r for rs in asked.values() for r in rs]))
                sent = {a: [next(results) for _ in rs] for a, rs in asked.items()}
            marks, out = np.zeros(len(b.pos), np.int64), []
            for i, c in enumerate(self.added):
                value, known = found[c]
                if self.digits is not None:
                    value, unsure = rounded(value, self.digits)
                    marks |= (unsure & known).astype(np.int64) << i
                out.append(pa.array(value, pa.float64(), mask=~known))
        return pa.RecordBatch.from_arrays([*[table[c] for c in self.kept], *out, pa.array(marks)],
                                          [*self.kept, *self.added, "_unsure"])


def rounded(values: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values rounded to some digits, and where they are left as they were: at and next to
    ties, which Spark decides by the decimal spelling, and where a double has too few digits."""
    scaled = np.abs(values) * 10.0 ** digits
    whole = np.floor(scaled)
    sure = (np.abs(scaled - whole - 0.5) > 1e-3) & (scaled < 1e11)
    # a whole number by a power of ten up to 10^22 is the double nearest to the decimal
    out = np.copysign(np.floor(scaled + 0.5) / 10.0 ** digits, values) + 0.0  # no -0.0
    return np.where(sure, out, values), ~sure


def _then_none(batches):
    yield from batches
    yield None
