"""First bars at which prices cross levels, for many probes of a symbol at once.

Bars and the rows that ask about them meet in one exchange on the symbol.  A task walks its
sorted rows, some whole symbols at a time, and answers all probes of these symbols with numpy:
the extremes of the next 1, 2, 4, ... bars are laid out once, and a probe steps over the widest
stretch that holds no crossing, then over narrower ones.  That is exact, without any horizon,
and takes a step per power of two of a symbol's bars.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# tasks get the functions of this module with the query: executors need not have the library
register_pickle_by_value(sys.modules[__name__])

KINDS = {"up": 0, "down": 1, "trail": 2}


def probe(kind: Column, level: Column, start: Column, end: Column, peak: Column | None = None) -> Column:
    """One probe of :func:`crossings`; without a level, a start or an end it finds nothing.
    ``kind`` is a number of ``KINDS``."""
    return F.struct(kind.cast("int").alias("kind"), level.cast("double").alias("level"),
                    start.cast("int").alias("start"), end.cast("int").alias("end"),
                    (F.lit(None) if peak is None else peak).cast("int").alias("peak"))


def crossings(bars: DataFrame, rows: DataFrame, prices: tuple[str, ...]) -> DataFrame:
    """``rows`` (with a code) whose array ``probes`` is replaced by ``hits``, one per probe:
    hit_idx, hit_date, target and ``prices`` of the first live bar from ``start`` to ``end``
    where high >= level (up), low <= level (down) or low <= level x the highest high since
    ``peak``, at most ``start`` (trail); NULL without one.  Rows without a code are left out.

    A task holds the rows of a symbol, which are at most as many as its bars, and of a batch.
    """
    cols = list(dict.fromkeys(["idx", "date", "high", "low", *prices]))
    kept = [c for c in rows.columns if c not in ("code", "probes")]
    of_bar = {f"_bar_{c}": bars.schema[c].dataType for c in cols}
    of_row = {f"_row_{c}": rows.schema[c].dataType for c in [*kept, "probes"]}
    nulls = lambda types: [F.lit(None).cast(t).alias(n) for n, t in types.items()]
    marks = bars.where(~F.col("halted") & F.col("code").isNotNull()).select(
        "code", F.lit(0).alias("_side"), *[F.col(c).alias(f"_bar_{c}") for c in cols], *nulls(of_row))
    asks = rows.where(F.col("code").isNotNull()).select(
        "code", F.lit(1).alias("_side"), *nulls(of_bar),
        *[F.col(f"`{c}`").alias(f"_row_{c}") for c in [*kept, "probes"]])
    hit = T.StructType([T.StructField("hit_idx", T.IntegerType()), T.StructField("hit_date", T.DateType()),
                        T.StructField("target", T.DoubleType()), *[bars.schema[c] for c in prices]])
    schema = T.StructType([rows.schema["code"], *[rows.schema[c] for c in kept],
                           T.StructField("hits", T.ArrayType(hit))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not held.num_rows:
                continue
            code = held["code"]
            cut = held.num_rows if batch is None else pc.index(code, code[-1]).as_py()
            if cut:
                yield from _answers(held.slice(0, cut), cols, prices, kept)
                held = held.slice(cut)

    return (marks.unionByName(asks).repartition("code").sortWithinPartitions("code", "_side", "_bar_idx")
            .mapInArrow(run, schema))


def _then_none(batches):
    yield from batches
    yield None


def _answers(table: pa.Table, cols: list[str], prices: tuple[str, ...], kept: list[str]):
    """The answered rows of some whole symbols; bars precede rows in each of them."""
    side = table["_side"].to_numpy()
    if not side.any():
        return
    is_bar, is_row = pa.array(side == 0), pa.array(side == 1)
    symbol = _whole(table["code"]).dictionary_encode().indices.to_numpy().astype(np.int64)
    bars = {c: _whole(table[f"_bar_{c}"].filter(is_bar)) for c in cols}
    out = [_whole(table[c].filter(is_row)) for c in ["code", *[f"_row_{c}" for c in kept]]]
    lists = _whole(table["_row_probes"].filter(is_row))
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    asked, of = lists.flatten(), np.repeat(symbol[side == 1], counts)
    where, target = _search(symbol[side == 0], bars, of, asked)
    none = where < 0
    at = pa.array(where, mask=none)
    fields = {"hit_idx": bars["idx"].take(at).cast(pa.int32()), "hit_date": bars["date"].take(at),
              "target": pa.array(target, mask=none), **{c: bars[c].take(at) for c in prices}}
    hits = pa.StructArray.from_arrays(list(fields.values()), list(fields), mask=pa.array(none))
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(pa.array(ends), hits)],
                                     ["code", *kept, "hits"])


def _whole(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def _numbers(column: pa.Array, null: float, nan: float) -> np.ndarray:
    out = column.cast(pa.float64()).to_numpy(zero_copy_only=False).copy()
    missing = column.is_null().to_numpy(zero_copy_only=False)
    out[np.isnan(out) & ~missing] = nan
    out[missing] = null
    return out


def _search(symbol: np.ndarray, bars: dict, of: np.ndarray, asked: pa.StructArray):
    """(place of the hit among the bars or -1, price that was crossed) of every probe."""
    none = asked.field("level").is_null().to_numpy(zero_copy_only=False)
    level = _numbers(asked.field("level"), np.inf, np.inf)
    kind, start, end = (asked.field(c).fill_null(-1).to_numpy().astype(np.int64)
                        for c in ("kind", "start", "end"))
    for c in ("start", "end"):
        none |= asked.field(c).is_null().to_numpy(zero_copy_only=False)
    peak = pc.coalesce(asked.field("peak"), asked.field("start")).fill_null(-1).to_numpy().astype(np.int64)
    base = symbol << 32
    place = base | bars["idx"].to_numpy().astype(np.int64)
    at = lambda idx, side: np.searchsorted(place, (of << 32) + np.maximum(idx, 0), side)
    first, after = at(start, "left"), np.where(none, 0, at(end, "right"))
    ask = np.flatnonzero(~none & (first < after))
    n = len(place)
    where, target = np.full(len(level), -1, np.int64), level.copy()
    if not len(ask):
        return where, target
    # a bar without a price crosses nothing; NaN is above all numbers, as in Spark
    high = np.append(_numbers(bars["high"], -np.inf, np.inf), -np.inf)
    low = np.append(_numbers(bars["low"], np.nan, np.nan), np.nan)
    longest = int(np.bincount(symbol - symbol[0]).max())
    steps = range(longest.bit_length())
    tops, floors = _doubled(high, steps, np.maximum), _doubled(low, steps, np.fmin)
    with np.errstate(invalid="ignore"):
        for k, holds in ((0, lambda j, i, x: tops[j][i] >= x), (1, lambda j, i, x: floors[j][i] <= x)):
            some = ask[kind[ask] == k]
            i = first[some]
            for j in reversed(steps):
                i = np.where(holds(j, i, level[some]), i, np.minimum(i + (1 << j), n))
            good = i < after[some]
            where[some[good]] = i[good]
        trailing = ask[kind[ask] == 2]
        for share in np.unique(level[trailing]):
            some = trailing[level[trailing] == share]
            since = at(peak, "left")[some]
            i = np.maximum(first[some], since)
            highest = _highest(tops, since, i)
            stops = _stops(tops, floors, steps, share)
            for j in reversed(steps):
                hold = stops[j][i] | (floors[j][i] <= highest * share)
                highest = np.where(hold, highest, np.maximum(highest, tops[j][i]))
                i = np.where(hold, i, np.minimum(i + (1 << j), n))
            good = i < after[some]
            where[some[good]] = i[good]
            target[some[good]] = np.maximum(highest, high[i])[good] * share
    return where, target


def _doubled(values: np.ndarray, steps: range, join) -> list[np.ndarray]:
    """Extremes of the next 1, 2, 4, ... values; the last value is a mark behind all bars."""
    out = [values]
    for j in steps[1:]:
        width, now = 1 << (j - 1), out[-1].copy()
        now[:-width] = join(now[:-width], out[-1][width:])
        out.append(now)
    return out


def _highest(tops: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The highest high from a to before b; -inf where there is none."""
    out, left = np.full(len(a), -np.inf), b - a
    at = a.copy()
    for j in reversed(range(len(tops))):
        use = left >= (1 << j)
        out[use] = np.maximum(out[use], tops[j][at[use]])
        at[use] += 1 << j
        left = np.where(use, left - (1 << j), left)
    return out


def _stops(tops, floors, steps: range, share: float) -> list[np.ndarray]:
    """Whether one of the next 1, 2, 4, ... bars is at or below ``share`` of the highest high
    among them so far."""
    out = [floors[0] <= tops[0] * share]
    for j in steps[1:]:
        width, now = 1 << (j - 1), out[-1].copy()
        now[:-width] |= out[-1][width:] | (floors[j - 1][width:] <= tops[j - 1][:-width] * share)
        out.append(now)
    return out
