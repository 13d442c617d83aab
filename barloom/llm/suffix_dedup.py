"""Suffix-array dedup of byte strings of a fixed length, over a whole corpus.

Sorting all suffixes of a corpus is not needed to know which ``window``-byte strings repeat:

1. Anchors: of every window the position of its least 32-byte hash.  Equal windows have equal
   anchors at the same distance, so only windows of anchors that occur twice can repeat.
   About one position in 180 is an anchor.
2. Surroundings: all windows of one anchor together are one stretch of bytes.  Stretches with
   equal 128-bit digests repeat as a whole, however many copies there are; copies are only
   counted, by partial aggregation.
3. Only anchors whose stretches differ are compared: one stretch of each kind goes to the
   anchor's task, where a suffix sort (``suffix_sort``) finds the common extensions.
4. An anchor with more than ``HOT`` different stretches does not go to one task: all its
   windows are counted by digest instead, which spreads them over all tasks.

Found windows are named by digest and place; a document takes out what matches its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from . import kernels as K
from .suffix_sort import repeated_offsets

WINDOW = 400
ANCHOR = 32
HOT = 20_000             # different stretches of an anchor that one task sorts
BATCH_BYTES = 4 << 20    # stretches sorted together in a task

_OCCURRENCE = "struct<h:bigint,d1:bigint,d2:bigint,p:int,a:int,b:int>"


def _anchors(s: K.Slice, window: int) -> tuple[np.ndarray, ...]:
    """(row, hash, anchor, first and last window start) of every anchor of a slice."""
    n = len(s.data) - ANCHOR + 1
    if len(s.data) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, *[np.int64] * 3))
    m = K.mix(K.load8(s.data)[:-1])
    h = m[:n].copy()
    for j in range(8, ANCHOR, 8):
        h *= K._M1
        h += m[j:j + n]
    h = K.mix(h)
    owner = K.owners(h, window - ANCHOR + 1)
    row = np.repeat(np.arange(s.rows, dtype=np.int32), np.diff(s.bounds))
    start = np.flatnonzero(row[:len(owner)] == row[window - 1:window - 1 + len(owner)])
    own = owner[start]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, *[np.int64] * 3))
    cut = np.flatnonzero((own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1))
    first = start[np.concatenate([[0], cut + 1])]
    last = start[np.concatenate([cut, [len(start) - 1]])]
    p = owner[first]
    return row[p].astype(np.int64), h[p], p, first, last


def _digest(stretch: bytes, anchor: int) -> tuple[int, int]:
    d = hashlib.blake2b(stretch, digest_size=16, salt=anchor.to_bytes(4, "little")).digest()
    return (int.from_bytes(d[:8], "little", signed=True),
            int.from_bytes(d[8:], "little", signed=True))


def _all_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, k, n): anchors of every document, added up within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                row, h, *_ = _anchors(s, window)
                if len(row):
                    key = K.mix(h) ^ K.mix(row.astype(np.uint64) + np.uint64(1))
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [K.as_long(h[first]), batch.column(0).take(pa.array(row[first] + s.first)),
                         pa.array(n.astype(np.int64))], ["h", "k", "n"])

    return docs.select("k", "text").mapInArrow(run, "h bigint, k bigint, n bigint")


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(k, h, d1, d2, p, a, b) of the anchors in a document's list ``hs``: the digest of the
    stretch, and anchor, begin and end of the stretch in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = K.flat(batch.column(2))
            known = np.unique(values.astype(np.int64).view(np.uint64))
            for s in K.slices(batch.column(1)):
                row, h, p, first, last = _anchors(s, window)
                if not len(row) or not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                row, h, p, first = row[hit], h[hit], p[hit], first[hit]
                end = last[hit] + window
                view = memoryview(s.data)
                d = [_digest(view[a:b], o) for a, b, o in zip(
                    first.tolist(), end.tolist(), (p - first).tolist())]
                base = s.bounds[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + s.first)), K.as_long(h),
                     pa.array([x[0] for x in d], pa.int64()),
                     pa.array([x[1] for x in d], pa.int64()),
                     *(pa.array((x - base).astype(np.int32)) for x in (p, first, end))],
                    ["k", "h", "d1", "d2", "p", "a", "b"])

    return docs.select("k", "text", "hs", "key").mapInArrow(
        run, "k bigint, h bigint, d1 bigint, d2 bigint, p int, a int, b int")


def _stretches(docs: DataFrame) -> DataFrame:
    """(h, d1, d2, p, part): bytes of the places listed in ``at``, verified by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, places in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.cast(pa.large_binary()).as_py() or b""
                for x in places:
                    part = data[x["a"]:x["b"]]
                    if _digest(part, x["p"] - x["a"]) == (x["d1"], x["d2"]):
                        out.append((x["h"], x["d1"], x["d2"], x["p"] - x["a"], part))
                if len(out) > 4096:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(out):
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["h", "d1", "d2", "p", "part"])

    return docs.select("text", "at", "key").mapInArrow(
        run, "h bigint, d1 bigint, d2 bigint, p int, part binary")


def _sort_groups(parts: DataFrame, window: int) -> DataFrame:
    """(d1, d2, ranges): repeated window starts of each stretch, by suffix sort per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows):
            ranges = repeated_offsets([r[4] for r in rows], np.array([r[3] for r in rows]),
                                      np.array([r[0] for r in rows]), window)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()),
                 pa.array(ranges, pa.list_(pa.int32()))], ["d1", "d2", "ranges"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size > BATCH_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    # a stretch that several rows with one key offered comes once
    once = parts.dropDuplicates(["h", "d1", "d2"])
    return (once.repartition("h").sortWithinPartitions("h")
            .mapInArrow(run, "d1 bigint, d2 bigint, ranges array<int>"))


def _count_windows(parts: DataFrame, window: int) -> DataFrame:
    """(d1, d2, ranges) of stretches of hot anchors: every window is counted by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d1, d2, p, part in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                n = len(part) - window + 1
                d = [_digest(part[o:o + window], p - o) for o in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d1] * n, pa.int64()), pa.array([d2] * n, pa.int64()),
                     pa.array(range(n), pa.int32()), pa.array([x[0] for x in d], pa.int64()),
                     pa.array([x[1] for x in d], pa.int64())], ["d1", "d2", "o", "w1", "w2"])

    rows = parts.dropDuplicates(["h", "d1", "d2"]).mapInArrow(
        run, "d1 bigint, d2 bigint, o int, w1 bigint, w2 bigint")
    twice = rows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return (rows.join(twice, ["w1", "w2"]).groupBy("d1", "d2")
            .agg(F.flatten(F.collect_set(F.array("o", F.col("o") + 1))).alias("ranges")))


def _remove(docs: DataFrame, window: int) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for s in K.slices(batch.column(1)):
                removed, spans, kept = [], [], []
                for i in range(s.rows):
                    data = bytes(s.text(i))
                    mark = None
                    for x in places[s.first + i].as_py() or ():
                        a = x["a"]
                        if _digest(data[a:x["b"]], x["p"] - a) != (x["d1"], x["d2"]):
                            continue
                        mark = np.zeros(len(data) + 1, np.int32) if mark is None else mark
                        r = x["ranges"] or (0, x["b"] - a - window + 1)
                        for low, high in zip(r[::2], r[1::2]):
                            mark[a + low] += 1
                            mark[a + high - 1 + window] -= 1
                    gone = np.zeros(0, bool) if mark is None else np.cumsum(mark)[:-1] > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                                 if len(gone) else 0)
                    kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes()
                                if removed[-1] else data)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows),
                     pa.array(np.diff(s.bounds).astype(np.int64)), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text", "at").mapInArrow(
        run, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text",
                          window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): UTF-8 bytes left without repeated strings.

    A byte goes if a string of ``window`` bytes that covers it starts at any other place of
    any row, its own included.  A null or empty text has no bytes; repeated rows repeat each
    other; a null key is a key.  ``kept`` is binary, as a cut may split a character.
    """
    # rows meet through a hash of the key: it needs not be unique, since what is taken out is
    # verified on the bytes
    pairs = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("k"),
                        F.col(text).alias("text"))
    anchors = stage(_all_anchors(pairs, window), "suffix-anchors")
    alive = anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    lists = anchors.join(alive, "h").groupBy("k").agg(F.collect_set("h").alias("hs"))
    # the texts are moved once: all joins below ask for the same exchange of (key, k, text),
    # which Spark reuses
    found = _occurrences(pairs.join(lists, "k"), window)

    kinds = found.groupBy("h", "d1", "d2").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("k", "p", "a", "b")))
    per_anchor = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"),
                                        F.min("n").alias("least"))
    mixed = per_anchor.where("kinds > 1 AND least = 1")
    wanted = (kinds.join(mixed, "h").groupBy("k", (F.col("kinds") > hot).alias("many"))
              .agg(F.collect_list(F.struct("h", "d1", "d2", "p", "a", "b")).alias("at")))
    bytes_of = lambda many: _stretches(
        pairs.join(wanted.where(F.col("many") == many), "k"))
    partly = (_sort_groups(bytes_of(False), window).union(_count_windows(bytes_of(True), window))
              .where("size(ranges) > 0"))
    whole = kinds.where("n > 1").select("d1", "d2")
    ranges = (partly.join(whole, ["d1", "d2"], "left_anti")
              .union(whole.withColumn("ranges", F.array().cast("array<int>"))))
    places = (found.join(ranges, ["d1", "d2"]).groupBy("k")
              .agg(F.collect_list(F.struct("p", "a", "b", "d1", "d2", "ranges")).alias("at")))
    return _remove(pairs.join(places, "k", "left"), window).withColumnRenamed("key", key)
