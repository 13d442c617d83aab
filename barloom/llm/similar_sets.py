"""Near-duplicates by the similarity of word shingle sets: SimHash first, then a complete join.

1. *Deletion-variant signatures* (:mod:`.simhash_dedup`): the 64-bit SimHashes of all distinct
   shingle sets are cut into three segments, one-wildcard variants are indexed and joined, and a
   forest of the pairs within five bits is compared set by set.  This links most near copies.
2. Fingerprints miss pairs near the limit, and the contract is to lose none.  An exact prefix join
   finds the rest: sets of the similarity share one of their first shingles in any common order (a
   fifth of them at 0.8; rare ones first).  Buckets of a shingle are looked at in rounds: every set
   with one pivot, then with its next few neighbours in a random order of the bucket, then all that
   is not connected yet.  Only pairs whose sets are not linked so far are candidates, so a large
   group of near copies is connected by a number of pairs in proportion to its size, and the last
   round has only the pairs between groups.  A round's links join the groups found before, so the
   components of a round are those of its new links alone.

Candidates are first held against a *sketch* of each set, two to four bits per shingle: whether
an odd number of shingles falls into a slot.  Two sets differ in a shingle at least for every slot
in which their sketches do, so dropping a pair that differs in too many loses nothing, and few
pairs that are not similar see their sets.  Then the sets themselves decide; every link is
verified.  Sets are not kept: those of a round's pairs are made again from their documents, which
are found by a bitmap of their keys, so that texts are not moved.  Sets are told apart by 64-bit
hashes of 64-bit shingle hashes.  A shingle that only one set has among its first goes no further.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import discarding, stage
from . import kernels as K
from .components import components
from .simhash_dedup import PAIRS, SMALL, MAX_RADIUS, by_root, fingerprint_links, majority, shingle_hashes
from .words import fresh

SLOT_BITS = 18               # shingles are counted in so many slots, for the order of prefixes
SLOTS = 1 << SLOT_BITS
LEAST_BITS = 512             # of a set's sketch
WANTED_BITS = 24             # a bitmap of wanted values has 2 ** 24 bits, in rows of 64
# (salt, neighbours): 0 is one pivot per bucket, None all pairs that are not connected yet
PAIR = ["a", "b", "ra", "rb"]   # two sets and the groups they are in so far
PAIR_ROW = ", ".join(f"{c} bigint" for c in PAIR)
ROUNDS = ((1, 0), (2, 8), (3, 64), (None, None))
SIGNATURES = (0, None)       # before them


def _set_rows(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """Rows (doc, key, fp, sim, n, sketch): hash, SimHash, number and sketch of the distinct
    shingles; rows (not doc, null, slot, null, n, null): shingles by slot, to be added up."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of = np.zeros(SLOTS, np.int64), None
        names = ["doc", "key", "fp", "sim", "n", "sketch"]
        for batch in batches:
            of, fps, sims, sizes, sketches = batch.schema.field(0).type, [], [], [], []
            for s in K.slices(batch.column(1)):
                for i in range(s.rows):
                    h = np.unique(shingle_hashes(bytes(s.text(i)), shingle))
                    np.add.at(counts, _slot(h), 1)
                    fps.append(_set_node(h))
                    sims.append(majority(h))
                    sizes.append(len(h))
                    sketches.append(_sketch(h))
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, bool)), batch.column(0), K.as_long(np.array(fps, np.uint64)),
                 K.as_long(np.array(sims, np.uint64)), pa.array(sizes, pa.int64()),
                 pa.array(sketches, pa.binary())], names)
        at = np.flatnonzero(counts)
        if of is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(at), bool)), pa.nulls(len(at), of), pa.array(at),
                 pa.nulls(len(at), pa.int64()), pa.array(counts[at]),
                 pa.nulls(len(at), pa.binary())], names)

    return picked.mapInArrow(
        run, f"doc boolean, key {kind.simpleString()}, fp bigint, sim bigint, n bigint, sketch binary")


def _sketch(h: np.ndarray) -> bytes:
    """One bit per slot: whether an odd number of the shingles falls into it.

    The slots are a power of two, two to four times the shingles, at least ``LEAST_BITS``.
    """
    bits = max(LEAST_BITS, 1 << (2 * len(h)).bit_length())
    odd = np.bincount((K.mix(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Slots in which two sketches differ, the larger one folded to the other's size."""
    x, y = sorted((x, y), key=len)
    a, b, n = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(y)
    while n > len(x):
        n //= 2
        b = (b >> 8 * n) ^ (b & ((1 << 8 * n) - 1))
    return (a ^ b).bit_count()


def _slot(h: np.ndarray) -> np.ndarray:
    return (K.mix(h) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _set_node(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 7)


def _prefixes(docs: DataFrame, text: str, shingle: int, similarity: float,
              rank: np.ndarray) -> DataFrame:
    """(k, fp, size, left): the first shingles of every set in the order of ``rank`` and hash.

    Two sets of this similarity share at least ``similarity`` of either one, so their firsts of
    size - ceil(similarity * size) + 1 shingles in a common order have one in common, whatever
    the order is.  ``left`` counts the shingles from k on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            for s in K.slices(batch.column(0)):
                cols, seen = [], set()
                for i in range(s.rows):
                    h = np.unique(shingle_hashes(bytes(s.text(i)), shingle))
                    fp, m = _set_node(h), len(h)
                    if not m or fp in seen:
                        continue
                    seen.add(fp)
                    first = m - math.ceil(similarity * m - 1e-6) + 1
                    k = h[np.argsort(rank[_slot(h)], kind="stable")[:first]]
                    cols.append((k, np.full(len(k), fp, np.uint64), np.full(len(k), m),
                                 m - np.arange(len(k))))
                if cols:
                    k, fp, m, left = (np.concatenate(c) for c in zip(*cols))
                    yield pa.RecordBatch.from_arrays(
                        [K.as_long(k), K.as_long(fp), pa.array(m.astype(np.int32)),
                         pa.array(left.astype(np.int32))], ["k", "fp", "size", "left"])

    return docs.select(F.col(text).alias("text")).mapInArrow(
        run, "k bigint, fp bigint, size int, left int")


def _by_bucket(index: DataFrame, names: list[str], work, schema: str) -> DataFrame:
    """``work`` over the columns of whole buckets, rows sorted by (k, fp)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                cols = [c.to_numpy() for c in batch.columns]
                held = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
            if held is None or not len(held[0]):
                continue
            k = held[0]
            cut = len(k) if batch is None else int(np.searchsorted(k, k[-1], side="left"))
            if cut:
                yield from work(*[c[:cut] for c in held])
                held = [c[cut:] for c in held]

    return (index.select(*names).repartition("k").sortWithinPartitions("k", "fp")
            .mapInArrow(run, schema))


def _then_none(batches):
    yield from batches
    yield None


def _bounds(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return first, np.diff(np.concatenate([first, [len(k)]]))


def _repeated(k, fp, size, left):
    """The rows of buckets with two sets or more, each set once."""
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])
    k, fp, size, left = k[new], fp[new], size[new], left[new]
    _, sizes = _bounds(k)
    many = np.repeat(sizes > 1, sizes)
    if many.any():
        yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (k, fp, size, left)],
                                         ["k", "fp", "size", "left"])


def _meetings(k, first, sizes):
    """All pairs of rows of the same bucket, in arrays: large buckets row by row."""
    large = sizes > SMALL
    for a, n in zip(first[large].tolist(), sizes[large].tolist()):
        for i in range(a, a + n - 1):
            y = np.arange(i + 1, a + n)
            yield np.full(len(y), i), y
    at = np.flatnonzero(np.repeat(~large, sizes))
    lag = 1
    while len(at):
        at = at[at + lag < len(k)]
        at = at[k[at] == k[at + lag]]
        yield at, at + lag
        lag += 1


def _candidates(salt: int | None, reach: int | None, similarity: float):
    """Pairs of a bucket with different roots that sizes and places allow to be similar: those
    with the bucket's pivot by ``salt`` (reach 0), with the next ``reach`` sets in the order of
    ``salt``, or all.  The order is another one in every bucket, so sets that share many shingles
    meet many of each other."""
    def may(size, left, x, y):
        # the shingles in common: at most those from the first common one on
        most = np.minimum(left[x], left[y])
        return most >= similarity * (size[x] + size[y] - most) - 1e-6

    def pairs(fp, root, x, y):
        x, y = np.where(fp[x] < fp[y], x, y), np.where(fp[x] < fp[y], y, x)
        _, one = np.unique(np.stack([fp[x], fp[y]], axis=1), axis=0, return_index=True)
        x, y = x[one], y[one]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (fp[x], fp[y], root[x], root[y])], PAIR)

    def near(k, fp, first, sizes):
        shuffled = K.mix(fp.view(np.uint64) ^ K.mix(k.view(np.uint64) + np.uint64(salt)))
        order = np.lexsort((shuffled, k))
        if not reach:
            yield np.repeat(order[first], sizes), order
        for lag in range(1, (reach or 0) + 1):
            x, y = order[:-lag], order[lag:]
            same = k[x] == k[y]
            yield x[same], y[same]

    def work(k, fp, size, left, root):
        first, sizes = _bounds(k)
        mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        keep = np.repeat(mixed, sizes)
        if not keep.any():
            return
        k, fp, size, left, root = (c[keep] for c in (k, fp, size, left, root))
        first, sizes = _bounds(k)
        meetings = _meetings(k, first, sizes) if salt is None else near(k, fp, first, sizes)
        xs, ys, held = [], [], 0
        for x, y in meetings:
            good = (root[x] != root[y]) & may(size, left, x, y)
            xs.append(x[good])
            ys.append(y[good])
            held += int(good.sum())
            if held > PAIRS:
                yield pairs(fp, root, np.concatenate(xs), np.concatenate(ys))
                xs, ys, held = [], [], 0
        if held:
            yield pairs(fp, root, np.concatenate(xs), np.concatenate(ys))

    return work


def _among(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``values`` (one column), and few others.

    The hashes of the values are marked in a bitmap of fixed size, which is sent to the rows: a row
    is never moved, however many values there are.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << WANTED_BITS))
    one = F.lit(1).cast("bigint")
    marks = (values.select(slot(F.col(values.columns[0])).alias("slot"))
             .groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", one, (F.col("slot") % 64).cast("int")))
                  .alias("bits")))
    return (rows.withColumn("slot", slot(F.col(column)))
            .join(F.broadcast(marks), F.shiftright("slot", 6) == F.col("word"))
            .where(F.getbit("bits", (F.col("slot") % 64).cast("int")) == 1).select(*rows.columns))


def _shingle_sets(docs: DataFrame, key: str, text: str, keys: DataFrame, shingle: int) -> DataFrame:
    """(fp, shingles) of the documents with ``keys``, and some others: distinct hashes, ascending."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(0)):
                sets = [np.unique(shingle_hashes(bytes(s.text(i)), shingle)) for i in range(s.rows)]
                values = np.concatenate([np.zeros(0, np.uint64), *sets])
                yield pa.RecordBatch.from_arrays(
                    [K.as_long(np.array([_set_node(x) for x in sets], np.uint64)),
                     K.lists(K.as_long(values), np.array(list(map(len, sets))))], ["fp", "shingles"])

    return (_among(picked, "key", keys).select("text").mapInArrow(run, "fp bigint, shingles array<bigint>")
            .groupBy("fp").agg(F.min("shingles").alias("shingles")))


def _bounded(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
            differ = np.fromiter((_differ(x.as_py(), y.as_py()) for x, y in zip(
                batch.column("x"), batch.column("y"))), np.int64, len(m))
            least = np.maximum(differ, np.abs(m - n))    # shingles that only one of the sets has
            good = m + n - least >= similarity * (m + n + least) - 1e-6
            yield batch.select(PAIR).filter(pa.array(good))

    few = _among(sketches, "fp", pairs.select(F.explode(F.array("a", "b"))))
    of = lambda c, n, x: few.select(F.col("fp").alias(c), F.col("size").alias(n),
                                    F.col("sketch").alias(x))
    return (pairs.join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b")
            .select(*PAIR, "m", "n", "x", "y").mapInArrow(run, PAIR_ROW))


def _alike(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, key: str, text: str, shingle: int,
           similarity: float) -> DataFrame:
    """(ra, rb): the groups of the pairs whose shingle sets have the similarity.

    Only the sets of pairs that the sketches let through are made.
    """
    left = stage(_bounded(stage(pairs, "similar-candidates"), sketches, similarity), "similar-pairs")
    keys = _among(sketches, "fp", left.select(F.explode(F.array("a", "b")))).select("of")
    sets = stage(_shingle_sets(docs, key, text, keys, shingle), "similar-sets")
    both = (left.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b"))
    same = F.size(F.array_intersect("x", "y"))
    return both.where(same >= similarity * (F.size("x") + F.size("y") - same)).select("ra", "rb").distinct()


def _signature_pairs(sims: DataFrame) -> DataFrame:
    """Pairs of set hashes with equal SimHashes or linked ones, as a forest; each set is a group."""
    heads = sims.groupBy("sim").agg(F.min("fp").alias("head"))
    equal = sims.join(heads, "sim").where("fp <> head").select(F.col("head").alias("a"),
                                                               F.col("fp").alias("b"))
    linked = (fingerprint_links(heads.select(F.col("sim").alias("fp")), MAX_RADIUS)
              .join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(
                  F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return (equal.union(linked).where("a <> b").distinct()
            .select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) after ``links`` between roots."""
    new = components(stage(links, "similar-links"), "similar-components").toDF("root", "least")
    return stage(roots.join(new, "root", "left").select("fp", F.coalesce("least", "root").alias("root")),
                 "similar-roots")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                      similarity: float = 0.8) -> DataFrame:
    """(key, fp, component), one row per row: groups of documents whose distinct word shingles have
    at least this Jaccard similarity, named by their least key.  ``fp`` is a hash of the set.

    Exact: all pairs of the similarity are connected, and only they.  A null or empty text has no
    shingles; such texts are one group.  Keys may be of any ordered type; a null key names a group
    only if it has no other; repeated rows keep one row each.  Other columns are not looked at.
    An empty table gives no rows.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity above 0 and at most 1")
    # of what the steps stage, the result reads the rows and the last groups alone
    with discarding(docs.sparkSession) as keep:
        found = stage(_set_rows(docs, key, text, shingle), "similar-found")
        rows = keep(stage(found.where("doc").select("key", "fp"), "similar-rows"))
        # frequent shingles come last; the slots only decide the order, so any number of them is right
        rank = np.zeros(SLOTS, np.uint8)
        counts = found.where("not doc").groupBy("fp").agg(F.sum("n").alias("n")).toArrow()
        rank[counts["fp"].to_numpy()] = np.minimum(8 * np.log2(counts["n"].to_numpy() + 1), 255)
        names = ["k", "fp", "size", "left"]
        index = stage(_by_bucket(_prefixes(docs, text, shingle, similarity, rank), names, _repeated,
                                 "k bigint, fp bigint, size int, left int"), "similar-index")
        # a set that shares none of its first shingles is similar to no other
        known = index.select("fp").distinct()
        sketches = stage(found.where("doc").groupBy("fp").agg(
            F.min("key").alias("of"), F.min("sim").alias("sim"), F.min("n").alias("size"),
            F.min("sketch").alias("sketch")).join(known, "fp", "left_semi"), "similar-sketches")
        roots = known.select("fp", F.col("fp").alias("root"))
        for salt, reach in (SIGNATURES, *ROUNDS):
            with discarding(docs.sparkSession) as pass_on:
                if (salt, reach) == SIGNATURES:
                    pairs = _signature_pairs(sketches.select("fp", "sim"))
                else:
                    pairs = _by_bucket(index.join(roots, "fp"), [*names, "root"],
                                       _candidates(salt, reach, similarity), PAIR_ROW).distinct()
                roots = pass_on(_joined(roots, _alike(pairs, sketches, docs, key, text, shingle, similarity)))
        keep(roots)
    return by_root(rows, roots.withColumnRenamed("fp", "node"), key)


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5,
                 similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of :func:`similar_documents`: the document whose key
    names the group.  Rows that repeat that key with the same text are copies: one stays.

    All columns stay as they were, whatever their names.
    """
    return keep_one(docs, similar_documents(docs, key, text, shingle, similarity), key, text)


def keep_one(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose key is a component of ``found`` (key, component)."""
    # a struct of the key is never null, so the join and the window share one exchange
    named, place = fresh(docs.columns, "named", "place")
    keep = (found.where(F.col(key).eqNullSafe(F.col("component")))
            .select(F.struct(F.col(key).alias("of")).alias(named)).distinct())
    first = (Window.partitionBy(named, F.xxhash64(F.col(f"`{text}`")))
             .orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return (docs.withColumn(named, F.struct(F.col(f"`{key}`").alias("of"))).join(keep, named, "left_semi")
            .withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
