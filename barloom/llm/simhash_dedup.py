"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments.  Two fingerprints that differ in at most
``radius`` <= 5 bits differ in at most one bit of some segment, so they share one of the
segment's variants in which one bit is a wildcard.  All 64 variants of every distinct
fingerprint are indexed; equal variants meet and the pair's distance is verified.

Memory and skew
* equal fingerprints are one entry however many documents carry them;
* a bucket never emits its pairs: the verified links of a task are reduced to a spanning
  forest, which keeps every connection;
* a bucket of more than ``BUCKET`` fingerprints is not compared there but indexed again on
  the bits outside its segment, by the same rule, so it is spread over many tasks.

64 bits with radius 5 find few pairs of a shingle similarity of 0.8: :mod:`.similar_sets` adds them.

:func:`wide_links` takes wide fingerprints of three 64-bit words: the first 160 bits are cut
into ten segments of 16 bits, and the distance is taken on all 192.  Each task keeps ``FORESTS``
disjoint forests of its closest pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from . import kernels as K
from .components import components

BITS = 64
SEGMENTS = (0, 22, 43, 64)   # bit positions at which a fingerprint is cut
MAX_RADIUS = 5               # three segments: six differing bits may leave none with one
BUCKET = 4096                # larger buckets are indexed a second time
PAIRS = 1 << 20              # verified pairs held before they are reduced to a forest
SMALL = 64                   # rows of a bucket that are compared at once with other buckets
FINE = tuple(range(0, 64, 7)) + (64,)            # cuts of the second index

WIDE = 3                     # words of a wide fingerprint
WIDE_CUTS = (0, 16, 32, 48, 64)                  # cuts of each word
WIDE_INDEXED = 160           # bits of a wide fingerprint that are indexed
WIDE_FINE = (0, 11, 22, 33, 43, 54, 64)          # 18 segments reach every pair up to radius 35
WIDE_RADIUS = 35
FORESTS = 4                  # disjoint forests of wide links a task keeps
WIDE_LEVELS = (8, 16, 24)    # forests of large buckets are also grown within these radii
WIDE_BUCKET = 1 << 14


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles (repeats included) of a lower-cased text.

    Fewer words than ``shingle`` are one shingle; no words have none.
    """
    words = text.lower().split()  # ASCII letters; splits at 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1:].tolist())),
                       np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 of none."""
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[a:a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles of a text; no words give 0."""
    return majority(shingle_hashes(text, shingle))


def wide_words(h: np.ndarray) -> list[int]:
    """``WIDE`` SimHashes of distinct shingle hashes, each by another hash function."""
    out = []
    for _ in range(WIDE):
        h = K.mix(h)
        out.append(majority(h))
    return out


def _names(words: int) -> list[str]:
    return ["fp"] if words == 1 else [f"w{n}" for n in range(words)]


def _node(words: np.ndarray) -> np.ndarray:
    """One number per fingerprint: itself, or a 64-bit hash of its words."""
    u = np.ascontiguousarray(words).view(np.uint64)
    out = u[:, 0]
    for n in range(1, u.shape[1]):
        out = K.mix(K.mix(out) + u[:, n])
    return out.view(np.int64)


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int, words: int = 1) -> DataFrame:
    """(key, fp BIGINT) of every row, for a wide fingerprint with its words w0, w1, ...

    A null text has no words.
    """
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = _names(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[fingerprint(bytes(s.text(i)), shingle)] if words == 1
                    else wide_words(np.unique(shingle_hashes(bytes(s.text(i)), shingle)))
                    for s in K.slices(batch.column(1)) for i in range(s.rows)]
            fps = np.array(rows, np.uint64).reshape(-1, words)
            cols = [K.as_long(np.ascontiguousarray(fps[:, n])) for n in range(words)]
            if words > 1:
                cols.insert(0, pa.array(_node(fps)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *cols], ["key", *(["fp"] if words > 1 else []), *names])

    kind = picked.schema["key"].dataType.simpleString()
    cols = ["fp"] if words == 1 else ["fp", *names]
    return picked.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} bigint" for c in cols))


def _variant(fp: Column, i: Column, cuts: tuple[int, ...]) -> Column:
    """The segment that holds bit i, without bit i, in place."""
    one, out = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for low, high in zip(cuts, cuts[1:]):
        mask = ((1 << high) - 1) & ~((1 << low) - 1)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        out = F.when((i >= low) & (i < high), F.lit(mask).cast("bigint")).otherwise(out)
    # shiftleft takes a column only in SQL text
    return fp.bitwiseAND(out).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, i)))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same connections as the given links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _closest_forests(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    """``FORESTS`` disjoint forests of the given links, each the closest of what is left.

    The first keeps every connection; the others stand in where the later comparison of sets
    refuses links of the first.
    """
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a, d))
    a, b, d = a[order], b[order], d[order]
    new = np.ones(len(a), bool)          # the same pair has the same distance
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, d = a[new], b[new], d[new]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)].tolist(), at[len(a):].tolist()
    left, kept = list(range(len(a))), []
    for _ in range(FORESTS):
        root, rest = list(range(len(nodes))), []
        for row in left:
            i, j = x[row], y[row]
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[j] = i
                kept.append(row)
            else:
                rest.append(row)
        left = rest
    return [c[np.array(kept, np.int64)] for c in (a, b, d)]


class _Links:
    """Links of a task, reduced to a forest when many are held.

    With ``exact`` some forests are kept that consist of the closest links (a, b, distance);
    otherwise one of any pairs (a, b) with the same connections.
    """

    def __init__(self, exact: bool) -> None:
        self.exact, self.rows, self.held, self.bound = exact, [], 0, PAIRS

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        if len(a):
            self.rows.append((a, b, d) if self.exact else (a, b))
            self.held += len(a)
            if self.held > self.bound:
                self.reduce()

    def reduce(self) -> list[np.ndarray]:
        if not self.rows:
            return [np.zeros(0, np.int64)] * (3 if self.exact else 2)
        cols = [np.concatenate(c) for c in zip(*self.rows)]
        if self.exact:
            cols = _closest_forests(*cols)
        else:
            cols = list(_forest(*cols))
        self.rows, self.held = [tuple(cols)], len(cols[0])
        self.bound = self.held + PAIRS
        return cols


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of two word arrays."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _grow(fps: np.ndarray, radius: int, links: _Links) -> None:
    """A spanning forest of one large bucket: every row meets the rows not reached before it.

    A tight group is reached in one step, so copies of a text with small edits cost little.
    """
    node, rest = _node(fps), np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            far = _far(fps[rest], fps[at:at + 1])
            near = far <= radius
            reached, rest = rest[near], rest[~near]
            links.add(np.full(len(reached), node[at]), node[reached], far[near])
            queue.extend(reached.tolist())


def _close(fps: np.ndarray, groups: np.ndarray, radius: int, links: _Links) -> None:
    """Links between rows of one group (rows of a group are neighbours)."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    first = first[:len(groups)]
    sizes = np.diff(np.concatenate([first, [len(groups)]]))
    for a, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for level in (*(WIDE_LEVELS if links.exact else ()), radius):
            _grow(fps[a:a + n], level, links)
    small = np.repeat(sizes <= SMALL, sizes)
    fps, groups = fps[small], groups[small]
    node = _node(fps)
    lag, left = 1, np.arange(len(fps) - 1)
    while len(left):
        left = left[left + lag < len(fps)]
        left = left[groups[left] == groups[left + lag]]
        far = _far(fps[left], fps[left + lag])
        near = left[far <= radius]
        links.add(node[near], node[near + lag], far[far <= radius])
        lag += 1


def _compare(index: DataFrame, radius: int, bucket: int | None, words: int) -> DataFrame:
    """(later, a, b, ...): links, and rows (bucket number, words) of too large buckets.

    Links of wide fingerprints have their distance in b1.
    """
    others = [f"b{n}" for n in range(1, words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, deferred = _Links(words > 1), None
        keep_k, keep_f = np.zeros(0, np.int64), np.zeros((0, words), np.int64)

        def out(a, b, later):
            cols = [pa.array(np.ascontiguousarray(b[:, n])) if n < b.shape[1]
                    else pa.nulls(len(a), pa.int64()) for n in range(words)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), later)), pa.array(a), *cols],
                                              ["later", "a", "b", *others])

        def parts():
            for batch in batches:
                yield (batch.column(0).to_numpy(), np.stack(
                    [batch.column(1 + n).to_numpy() for n in range(words)], axis=1), False)
            yield np.zeros(0, np.int64), np.zeros((0, words), np.int64), True

        for k, f, last in parts():
            if deferred is not None and len(k):      # the rest of a large bucket goes on
                rest = int(np.searchsorted(k, deferred, side="right"))
                if rest:
                    yield out(k[:rest], f[:rest], True)
                    k, f = k[rest:], f[rest:]
                if len(k):
                    deferred = None
            k, f = np.concatenate([keep_k, k]), np.concatenate([keep_f, f])
            if not len(k):
                continue
            cut = len(k) if last else int(np.searchsorted(k, k[-1], side="left"))
            if bucket is not None:
                large = np.zeros(len(k), bool)
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                sizes = np.diff(np.concatenate([first, [len(k)]]))
                large = np.repeat(sizes > bucket, sizes)
                if large.any():
                    yield out(k[large], f[large], True)
                    if large[-1] and not last:
                        deferred, cut = k[-1], len(k)
                done_k, done_f = k[:cut][~large[:cut]], f[:cut][~large[:cut]]
            else:
                done_k, done_f = k[:cut], f[:cut]
            _close(done_f, done_k, radius, links)
            keep_k, keep_f = k[cut:], f[cut:]
        a, *b = links.reduce()
        yield out(a, np.stack(b, axis=1), False)

    return (index.repartition("k").sortWithinPartitions("k")
            .mapInArrow(run, "later boolean, a bigint, b bigint"
                        + "".join(f", {c} bigint" for c in others)))


def fingerprint_links(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a forest with the components of all pairs of distinct ``fps.fp`` within radius."""
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"three segments reach every pair up to radius {MAX_RADIUS}")
    return _links(fps, radius, bucket, 1, SEGMENTS, BITS, FINE)


def wide_links(fps: DataFrame, radius: int = WIDE_RADIUS, bucket: int = WIDE_BUCKET) -> DataFrame:
    """(a, b, d): links between the nodes of distinct wide fingerprints (w0, w1, w2).

    All pairs within ``radius`` bits that differ in at most one bit of some indexed segment
    are connected; d is the distance of the linked pair.
    """
    if not 0 <= radius <= WIDE_RADIUS:
        raise ValueError(f"the second index reaches every pair up to radius {WIDE_RADIUS}")
    return _links(fps, radius, bucket, WIDE, WIDE_CUTS, WIDE_INDEXED, WIDE_FINE)


def _links(fps: DataFrame, radius: int, bucket: int, words: int, cuts: tuple[int, ...],
           indexed: int, fine: tuple[int, ...]) -> DataFrame:
    names = _names(words)
    cols, i = [F.col(c) for c in names], F.col("i")

    def variants(rows: DataFrame, bits: int, at: tuple[int, ...], *within: str) -> DataFrame:
        word = cols[0]
        for n in range(1, words):
            word = F.when(i >= BITS * n, cols[n]).otherwise(word)
        return (rows.select(*within, *names,
                            F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("i"))
                .select(F.xxhash64(*within, i, _variant(word, i % BITS, at)).alias("k"), *names))

    found = stage(_compare(variants(fps, indexed, cuts), radius, bucket, words), "simhash-links")
    # second index of large buckets: the bits of the whole fingerprint, cut finer
    rows = found.where("later").select(
        F.col("a").alias("k0"), *[F.col("b" if n == 0 else f"b{n}").alias(c)
                                  for n, c in enumerate(names)])
    again = _compare(variants(rows, BITS * words, fine, "k0"), radius, None, words)
    link = ["a", "b"] if words == 1 else ["a", "b", F.col("b1").alias("d")]
    return found.where("not later").select(*link).union(again.select(*link))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """(key, fp, component): every row, with the least key reachable over linked fingerprints.

    Equal fingerprints are linked, also those of texts without words (fingerprint 0).  Rows
    that repeat a key keep one row each.  A null key is never a component unless the
    component has no other.  An empty table gives no rows.
    """
    rows = stage(fingerprints(docs, key, text, shingle), "simhash-fingerprints")
    return grouped(rows, fingerprint_links(rows.select("fp").distinct(), radius), key)


def grouped(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return by_root(rows, components(links, "simhash-components"), key)


def by_root(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, fp, component) of ``rows`` (key, fp), given (node, root) of what is linked."""
    fps = rows.groupBy("fp").agg(F.min("key").alias("least"))
    member = (fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    named = member.select("fp", "root").join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                         shingle: int = 5, radius: int = 5) -> DataFrame:
    """``docs`` with one row of each group: of the document whose key names the group.

    All columns stay.  Rows that repeat that key with the same text are copies: one stays.
    """
    from .similar_sets import keep_one

    return keep_one(docs, near_duplicates(docs, key, text, shingle, radius), key, text)
