"""Substring dedup by level-wise doubling.

Windows of few words are looked at first; only where they repeat in several documents are
they extended to twice that length, then again, until the wanted length is reached or no
candidate survives.  For 13 words the levels are 6 and 13.

* Of the first level only the positions that are the minimum of their surroundings are
  counted: every window of the second level holds one, and equal windows hold equal ones, so
  no repeat is missed and a quarter of the positions is moved.
* At the last level all windows around one anchor are one stretch of text.  Where all
  documents have the same stretch around an anchor, one row per document stands for all its
  windows; only anchors with different stretches are compared window by window.
* A text that equals one with a smaller key goes whole; it is known by its digest and takes no
  part in the levels, as the smaller key stands for it.
* Counting is a partial aggregation before the shuffle, so a passage that a third of all
  documents share is one row per task.  The join back has only unique keys on one side, so
  its large side can be split.
* Keys of the last level have 96 bits (a 64-bit hash and a 32-bit one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW = 13
FIRST_LEVEL = 7          # longest window to begin with


def levels(window: int) -> list[int]:
    """Window lengths, each about half of the next: 50 -> [6, 12, 25, 50]."""
    out = [window]
    while out[0] > FIRST_LEVEL:
        out.insert(0, out[0] // 2)
    return out


def _inside(rows: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` words lie in one document."""
    n = len(rows) - length + 1
    return rows[:n] == rows[length - 1:] if n > 0 else np.zeros(0, bool)


def _anchors(h: np.ndarray, rows: np.ndarray, short: int, length: int):
    """Hash and owner position: for each window of ``length`` its least window of ``short``."""
    parts = K.window_hashes(h, short)
    return parts, K.owners(parts, length - short + 1)


class _Survivors:
    """Membership of (row, hash) in the lists of a batch's rows."""

    def __init__(self, column: pa.Array):
        values, self.bounds = K.flat(column)
        self.values = values.astype(np.int64).view(np.uint64)

    def have(self, first: int, rows: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(rows) or not len(self.values):
            return np.zeros(len(h), bool)
        low, high = self.bounds[first + rows[0]], self.bounds[first + rows[-1] + 1]
        owner = np.repeat(np.arange(first + rows[0], first + rows[-1] + 1), np.diff(
            self.bounds[first + rows[0]:first + rows[-1] + 2]))
        salt = lambda r: K.mix(r.astype(np.uint64) + np.uint64(1))
        known = np.sort(self.values[low:high] ^ salt(owner))
        if not len(known):
            return np.zeros(len(h), bool)
        wanted = h ^ salt(rows + first)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return known[at] == wanted


def _stretches(h: np.ndarray, rows: np.ndarray, short: int, length: int) -> dict[str, np.ndarray]:
    """All windows of ``length`` words of one document that have the same anchor, together:
    first and last window, the anchor's hash, and a hash and a check of all their words."""
    part, owner = _anchors(h, rows, short, length)
    start = np.flatnonzero(_inside(rows, length))
    own = owner[start]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    none = start[:0]
    first = start[np.concatenate([[0], cut])] if len(start) else none
    last = start[np.concatenate([cut - 1, [len(start) - 1]])] if len(start) else none
    out = {"first": first, "last": last, "anchor": part[owner[first]], "doc": rows[first]}
    for name, base in (("hash", 0x9E3779B97F4A7C15), ("check", 0xC2B2AE3D27D4EB4F)):
        # polynomial prefix hash of the words; the inverse power moves a stretch to the front
        power = np.cumprod(np.full(len(h) + 1, base, np.uint64))
        inverse = np.cumprod(np.full(len(h) + 1, pow(base, -1, 1 << 64), np.uint64))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:len(h)], dtype=np.uint64)])
        x = (prefix[last + length] - prefix[first]) * inverse[first]
        out[name] = K.mix(x ^ K.mix((last - first).astype(np.uint64) << np.uint64(32)
                                    | (owner[first] - first).astype(np.uint64)))
    out["check"] = (out["check"] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _distinct(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions of the first of each (hash, document)."""
    _, first = np.unique(K.mix(h) ^ K.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.sort(first)


def _candidates(known: _Survivors, s: K.Slice, h, rows, sizes: list[int], level: int) -> np.ndarray:
    """Which windows of a level hold only survivors of the level before."""
    if level == 1:
        part, owner = _anchors(h, rows, sizes[0], sizes[1])
        had = known.have(s.first, rows[:len(part)], part)
        return _inside(rows, sizes[1]) & had[owner]
    before, shift = sizes[level - 1], sizes[level] - sizes[level - 1]
    ok = _inside(rows, sizes[level])
    had = known.have(s.first, rows[:max(len(h) - before + 1, 0)], K.window_hashes(h, before))
    return ok & had[:len(ok)] & had[shift:shift + len(ok)]


def _slices(batch: pa.RecordBatch, lists: bool):
    """(slice, survivors, word hashes, rows) of the slices of a batch that have any."""
    known = _Survivors(batch.column(2)) if lists else None
    for s in K.slices(batch.column(1)):
        if known is None or known.bounds[s.first] < known.bounds[s.first + s.rows]:
            starts, ends, rows = K.word_bounds(s)
            yield s, known, K.hash_runs(s.data, starts, ends), rows


def _level_rows(docs: DataFrame, sizes: list[int], level: int, mode: str) -> DataFrame:
    """Candidates of a level, distinct within a slice: (h, key), and more by ``mode``.

    level: (h, key) of the windows of a level before the last.
    stretch: (h, d, g, key): anchor, hash and check of a stretch with a candidate.
    window: (h, g, key): windows whose anchor is in the document's list.
    ``docs``: key, text and, from the second level on, ``hs``, the survivors of a document.
    """
    length, listed = sizes[level], "hs" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, known, h, rows in _slices(batch, listed):
                keys = lambda doc: batch.column(0).take(pa.array(doc + s.first))  # noqa: E731, B023
                named = ~pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)[s.first:]
                if mode == "stretch":
                    x = _stretches(h, rows, sizes[0], length)
                    total = np.concatenate([[0], np.cumsum(
                        _candidates(known, s, h, rows, sizes, level))])
                    at = np.flatnonzero((total[x["last"] + 1] > total[x["first"]])
                                        & named[x["doc"]])
                    at = at[_distinct(x["hash"][at], x["doc"][at])]
                    yield pa.RecordBatch.from_arrays(
                        [K.as_long(x["anchor"][at]), K.as_long(x["hash"][at]),
                         pa.array(x["check"][at]), keys(x["doc"][at])], ["h", "d", "g", "key"])
                    continue
                if level == 0 and len(sizes) > 1:
                    own, at = _anchors(h, rows, sizes[0], sizes[1])
                    at = np.unique(at[_inside(rows, sizes[1])])
                else:
                    own = K.window_hashes(h, length)
                    if mode == "window" and known is not None:
                        part, owner = _anchors(h, rows, sizes[0], length)
                        had = known.have(s.first, rows[:len(part)], part)
                        at = np.flatnonzero(_inside(rows, length) & had[owner])
                    elif level:
                        at = np.flatnonzero(_candidates(known, s, h, rows, sizes, level))
                    else:
                        at = np.flatnonzero(_inside(rows, length))
                at = at[named[rows[at]]]
                at = at[_distinct(own[at], rows[at])]
                if mode == "level":
                    yield pa.RecordBatch.from_arrays([K.as_long(own[at]), keys(rows[at])],
                                                     ["h", "key"])
                else:
                    check = K.window_hashes(h ^ np.uint64(0x5BD1E995), length)[at]
                    yield pa.RecordBatch.from_arrays(
                        [K.as_long(own[at]),
                         pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                         keys(rows[at])], ["h", "g", "key"])

    kind = docs.schema["key"].dataType.simpleString()
    more = {"level": "", "stretch": "d bigint, g int, ", "window": "g int, "}[mode]
    picked = docs.select("key", "text", *(["hs"] if listed else []))
    return picked.mapInArrow(run, f"h bigint, {more}key {kind}")


def _hashes_by_key(rows: DataFrame, column: str = "h", name: str = "hs") -> DataFrame:
    """A document's hashes in one list (as many as it has windows, at most)."""
    return rows.groupBy("key").agg(F.collect_set(column).alias(name))


def _remove(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, n_words, n_removed, kept) from key, text and the hashes of the windows (``hs``)
    and of the stretches (``ds``) to remove; a ``copy`` goes whole if it has a window."""
    window = sizes[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single, whole = _Survivors(batch.column(2)), _Survivors(batch.column(3))
            some = lambda k, s: k.bounds[s.first] < k.bounds[s.first + s.rows]
            for s in K.slices(batch.column(1)):
                starts, ends, rows = K.word_bounds(s)
                gone = np.zeros(len(starts) + 1, np.int32)
                if some(single, s) or some(whole, s):
                    h = K.hash_runs(s.data, starts, ends)
                if some(single, s):
                    own = K.window_hashes(h, window)
                    hit = np.flatnonzero(_inside(rows, window)
                                         & single.have(s.first, rows[:len(own)], own))
                    np.add.at(gone, hit, 1)
                    np.subtract.at(gone, hit + window, 1)
                if some(whole, s):
                    x = _stretches(h, rows, sizes[0], window)
                    hit = whole.have(s.first, x["doc"], x["hash"])
                    np.add.at(gone, x["first"][hit], 1)
                    np.subtract.at(gone, x["last"][hit] + window, 1)
                gone = np.cumsum(gone)[:len(starts)] > 0
                edges = np.searchsorted(rows, np.arange(s.rows + 1))
                copy = batch.column(4).slice(s.first, s.rows).to_numpy(zero_copy_only=False)
                gone |= (copy & (np.diff(edges) >= window))[rows]
                kept, removed = [], []
                for i in range(s.rows):
                    words, out = bytes(s.text(i)).split(), gone[edges[i]:edges[i + 1]]
                    removed.append(int(out.sum()))
                    if removed[-1]:
                        words = [w for w, x in zip(words, out.tolist()) if not x]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows), pa.array(np.diff(edges)),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["key", "n_words", "n_removed", "kept"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_words bigint, n_removed bigint, kept string")


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept): words left after removing repeated windows.

    A word goes if a window of ``window`` words that covers it also starts in a document with
    a smaller key.  Windows are judged on the input.  Null and empty texts have no words; a
    document with a null key is left as it is and removes nothing; rows that repeat a key
    count as one document and are all treated.
    """
    # the texts are moved once: every join asks for the same exchange, which Spark reuses.
    # ``k`` is never null, so no join puts a filter of its own below that exchange.
    kind = docs.schema[key].dataType
    none = F.lit("\0") if kind.simpleString() == "string" else F.lit(-(1 << 31)).cast(kind)
    pairs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key), none).alias("k"),
                        F.col(text).alias("text"))
    meet = lambda lists, how="inner": pairs.join(
        lists.withColumnRenamed("key", "k"), "k", how)
    digest = F.md5(F.col("text").cast("binary"))
    texts = pairs.where("key IS NOT NULL AND text IS NOT NULL").select("key", digest.alias("t"))
    copies = _hashes_by_key(
        texts.join(texts.groupBy("t").agg(F.min("key").alias("low")), "t").where("key > low"),
        "t", "ts")
    copy = F.coalesce(F.array_contains("ts", digest), F.lit(False))
    sizes = levels(window)
    now = meet(copies, "left").where(~copy).select("key", "text")
    for level in range(len(sizes) - 1):
        rows = _level_rows(now, sizes, level, "level")
        seen = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        now = meet(_hashes_by_key(rows.join(seen, "h")))
    if len(sizes) > 1:
        rows = _level_rows(now, sizes, len(sizes) - 1, "stretch")
        per_anchor = rows.groupBy("h").agg(
            F.min("key").alias("low"),
            *(f(c).alias(f"{c}{i}") for i, f in enumerate((F.min, F.max)) for c in ("d", "g")))
        judged = rows.join(per_anchor, "h").withColumn("one", F.expr("d0 = d1 AND g0 = g1"))
        whole = _hashes_by_key(judged.where("one AND key > low"), "d", "ds")
        now = meet(_hashes_by_key(judged.where("NOT one")))
    else:
        whole = _hashes_by_key(pairs.where("false").selectExpr("key", "0L AS d"), "d", "ds")
    rows = _level_rows(now, sizes, len(sizes) - 1, "window")
    least = rows.groupBy("h", "g").agg(F.min("key").alias("low"))
    gone = _hashes_by_key(rows.join(least, ["h", "g"]).where("key > low"))
    lists = gone.join(whole, "key", "full").join(copies, "key", "full")
    # a real key may equal the one that stands for null: its lists are not for null keys
    own = lambda c: F.when(F.col("key").isNotNull(), c)
    left = meet(lists, "left").select("key", "text", own(F.col("hs")).alias("hs"), own(F.col("ds")).alias("ds"),
                                      (F.col("key").isNotNull() & copy).alias("copy"))
    return _remove(left, sizes).withColumnRenamed("key", key)
