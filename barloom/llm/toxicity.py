"""Toxicity by the nearest labelled examples in exact TF-IDF cosine.

* Terms are case-folded words and the first six bytes of longer ones; the vocabulary is every
  term of the examples.  Document frequencies are counted over all documents.  A weight is
  (1 + log count) * idf * (``FLOOR`` + how far the share of toxic examples among those with the
  term lies above the share among all), so every term counts and telling ones count more.
* Examples are kept in an inverted index: the postings of a term lie by blocks of examples, each
  with its largest weight.  A text adds up these to a bound for every block, looks at blocks in
  the order of their bounds and stops when no block left can reach its k-th neighbour, so the
  neighbours are exact.  The ``FULL`` longest lists have no gaps and no block weights: their part
  of the cosines is known exactly before the blocks are ordered.
* A score is the vote of the neighbours weighted by similarity, drawn to the share of toxic
  examples by ``PRIOR`` votes.  A text without vocabulary terms gets the share among the
  examples that have none either.  The neighbours are returned as evidence.

The examples are bounded in number and in characters, and the index with them; texts are scored
where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from . import kernels as K
from .decontamination import folded_words
from .labelled import EXAMPLES, examples, held_out

EXAMPLE_CHARS = 1 << 25      # bound on the characters of all examples
FLOOR, SMOOTH = 0.1, 4.0
NEIGHBOURS = 15
PRIOR = 2.0
BLOCK = 64
FULL = 1024                  # lists kept without gaps; where they lie changes no result
GROUP = 512                  # texts multiplied at once
FIRST, MORE = 4, 32          # blocks looked at first, and how many times as many next
THRESHOLD = 0.3
PREFIX = 6


def _terms(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes and rows of a slice: words, and beginnings of longer words."""
    data, starts, ends, rows = folded_words(s)
    long = np.flatnonzero(ends - starts > PREFIX)
    beginning = K.mix(K.hash_runs(data, starts[long], starts[long] + PREFIX) ^ np.uint64(PREFIX))
    return (np.concatenate([K.hash_runs(data, starts, ends), beginning]),
            np.concatenate([rows, rows[long]]))


def _counts(s: K.Slice, known: np.ndarray | None = None):
    """(row, term, count) of a slice by row and term; with ``known`` (sorted) the place in it."""
    h, rows = _terms(s)
    words, at = np.unique(h, return_inverse=True)
    if known is not None:
        place = np.searchsorted(known, words)
        found = np.zeros(len(words), bool)
        inside = place < len(known)
        found[inside] = known[place[inside]] == words[inside]
        hit = found[at]
        words, at, rows = place, at[hit], rows[hit]
    pair, n = np.unique(rows.astype(np.int64) * max(len(words), 1) + at, return_counts=True)
    row, at = np.divmod(pair, max(len(words), 1))
    return row, words[at], n


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every start, ``sizes`` of each."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _train(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int,
           chars: int) -> DataFrame:
    """(key, y, text) of the examples: one per key, of its least text, as many in the order of a
    hash of the key as hold at most ``chars`` characters."""
    found = stage(examples(docs, labels, label, key, text, rows).groupBy("key").agg(
        F.max("y").alias("y"), F.min(F.coalesce("text", F.lit(""))).alias("text")), "toxic-examples")
    # at most ``rows`` keys with the lengths of their texts
    upto = Window.orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0)
    few = (found.select("key", F.length("text").alias("n"))
           .withColumn("n", F.sum("n").over(upto)).where(F.col("n") <= chars).select("key"))
    return found.join(F.broadcast(few), "key", "left_semi")


def _vectors(train: DataFrame) -> pa.Table:
    """(key, y, terms, counts) of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(2)):
                row, term, n = _counts(s)
                each = np.bincount(row, minlength=s.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows), batch.column(1).slice(s.first, s.rows),
                     K.lists(K.as_long(term), each), K.lists(pa.array(n.astype(np.int32)), each)],
                    ["key", "y", "t", "n"])

    kind = train.schema["key"].dataType.simpleString()
    return (train.select("key", "y", "text")
            .mapInArrow(run, f"key {kind}, y int, t array<bigint>, n array<int>")
            .toArrow())


def _document_frequency(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents, over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = shared.value, 0
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for s in K.slices(batch.column(0)):
                total += np.bincount(_counts(s, known)[1], minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["i", "n"])

    got = (docs.select("text").mapInArrow(run, "i bigint, n bigint").groupBy("i")
           .agg(F.sum("n").alias("n")).toArrow())
    i, n = got["i"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(known))
    df[i[i >= 0]] = n[i >= 0]
    return df, int(n[i < 0].sum())


def term_weights(df: np.ndarray, n: int, holding: np.ndarray, toxic: np.ndarray,
                 rate: float) -> np.ndarray:
    """Weight of each term: idf over ``n`` documents, times its bearing on the label.

    ``holding`` examples have the term, ``toxic`` of these carry the label, as ``rate`` of all do.
    """
    share = (toxic + SMOOTH * rate) / (holding + SMOOTH)
    return (np.log((1 + n) / (1 + df)) + 1) * (FLOOR + np.maximum(0, share - rate))


class Index:
    """Block-max inverted index of the examples, and the search in it."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, keys: list, y: np.ndarray,
                 row: np.ndarray, term: np.ndarray, count: np.ndarray, k: int = NEIGHBOURS):
        """``keys`` and ``y`` of the examples, ascending; (row, term, count) of their terms by
        row, terms as places in ``known`` with ``weight``."""
        self.known, self.weight, self.k = known, weight, k
        self.rate = float(np.mean(y)) if len(y) else 0.5
        held = np.bincount(row, minlength=len(y))
        none = np.asarray(y)[held == 0]
        self.none = float((none.sum() + PRIOR * self.rate) / (len(none) + PRIOR))
        w = ((1 + np.log(count)) * weight[term]).astype(np.float32)
        w /= np.sqrt(np.bincount(row, w * w, minlength=len(y))).astype(np.float32)[row]
        # neighbours in a block share their heaviest term, so block bounds are tight
        use = np.flatnonzero(held)
        heavy = term[np.lexsort((-w, row))[(np.cumsum(held) - held)[use]]]
        use = use[np.lexsort((use, heavy))]
        self.keys, self.y, self.rank = [keys[i] for i in use], np.asarray(y, float)[use], use
        place = np.zeros(len(y), np.int32)
        place[use] = np.arange(len(use))
        self.blocks = -(-len(use) // BLOCK)
        posting = place[row]
        # terms of most examples: lists without gaps, multiplied at once for many texts
        held = np.bincount(term, minlength=len(known))
        full = np.argsort(-held, kind="stable")[:FULL]
        full = full[held[full] > self.blocks]
        self.full_at = np.full(len(known), -1, np.int32)
        self.full_at[full] = np.arange(len(full))
        self.full = np.zeros((len(full), self.blocks * BLOCK), np.float32)
        at = self.full_at[term]
        self.full[at[at >= 0], posting[at >= 0]] = w[at >= 0]
        term, posting, w = term[at < 0], posting[at < 0], w[at < 0]
        order = np.lexsort((posting, term))
        term, w = term[order], w[order]
        self.example, self.w = posting[order].astype(np.int32), w
        del row, count, at, posting, order
        block = self.example // BLOCK
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(first)
        # runs of postings: one term in one block
        self.run = np.append(first, len(term))
        self.block = block[first]
        self.most = np.maximum.reduceat(self.w, first) if len(first) else self.w
        self.runs_of = np.searchsorted(term[first], np.arange(len(known) + 1))

    def query(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return (w / np.sqrt((w * w).sum())).astype(np.float32)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        """(example, cosine) of the k nearest with a common term, for each text's terms and
        counts; ties go to the least key."""
        for a in range(0, len(texts), GROUP):
            group = [(t, self.query(t, n)) for t, n in texts[a:a + GROUP]]
            full = np.zeros((len(group), len(self.full)), np.float32)
            for i, (t, q) in enumerate(group):
                at = self.full_at[t]
                full[i, at[at >= 0]] = q[at >= 0]
            for (t, q), part in zip(group, full @ self.full):
                rest = self.full_at[t] < 0
                yield self._nearest(t[rest], q[rest], part)

    def _nearest(self, terms: np.ndarray, q: np.ndarray, part: np.ndarray):
        """The nearest, given the other terms and the ``part`` of the full lists in all cosines."""
        n = self.runs_of[terms + 1] - self.runs_of[terms]
        runs, q = _ranges(self.runs_of[terms], n), np.repeat(q, n)
        of = self.block[runs]
        bound = (np.bincount(of, self.most[runs] * q, minlength=self.blocks)
                 + part.reshape(-1, BLOCK).max(1))
        order = np.argsort(-bound, kind="stable")
        best, value = np.zeros(0, np.int64), np.zeros(0)
        done, step, chosen = 0, FIRST, np.zeros(self.blocks, bool)
        while done < self.blocks:
            least = value[-1] - 1e-5 if len(value) == self.k else 0.0
            now = order[done:done + step]
            now = now[bound[now] > max(least, 0.0)]
            if not len(now):
                break
            chosen[:] = False
            chosen[now] = True
            at = np.flatnonzero(chosen[of])
            size = self.run[runs[at] + 1] - self.run[runs[at]]
            post = _ranges(self.run[runs[at]], size)
            score = np.bincount(self.example[post], self.w[post] * np.repeat(q[at], size),
                                minlength=len(part)) + part
            some = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            hit = some[score[some] > max(least, 0.0)]
            best, value = np.concatenate([best, hit]), np.concatenate([value, score[hit]])
            top = np.lexsort((self.rank[best], -np.round(value, 6)))[:self.k]
            best, value = best[top], value[top]
            done, step = done + step, MORE * step
        return best, value

    def score(self, best: np.ndarray, value: np.ndarray) -> float:
        got = (value @ self.y[best] + PRIOR * self.rate) / (value.sum() + PRIOR)
        return round(float(min(max(got, 0.0), 1.0)), 6)


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str,
        rows: int = EXAMPLES, chars: int = EXAMPLE_CHARS, k: int = NEIGHBOURS) -> Index:
    """The index over at most ``rows`` examples of at most ``chars`` characters together."""
    got = _vectors(_train(docs, labels, label, key, text, rows, chars))
    keys, order = got["key"].to_pylist(), pc.sort_indices(got["key"]).to_numpy()
    place = np.argsort(order).astype(np.int32)
    row = np.repeat(place, got["t"].combine_chunks().value_lengths().to_numpy())
    known, term = np.unique(K.flat(got["t"])[0].view(np.uint64), return_inverse=True)
    count = K.flat(got["n"])[0].astype(np.float32)
    keys, y = [keys[i] for i in order], got["y"].to_numpy()[order].astype(float)
    del got
    pa.default_memory_pool().release_unused()
    by_row = np.lexsort((term, row))
    row, term, count = row[by_row], term[by_row].astype(np.int32), count[by_row]
    del by_row
    df, n = _document_frequency(docs.select(F.col(text).alias("text")), known)
    weight = term_weights(df, n, np.bincount(term, minlength=len(known)),
                          np.bincount(term, y[row], minlength=len(known)),
                          float(y.mean()) if len(y) else 0.5)
    pa.default_memory_pool().release_unused()
    return Index(known, weight, keys, y, row, term, count, k)


def score_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id",
                text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """(key, held_out, score, predicted, evidence) of every row; repeated rows are scored alike.

    ``evidence``: the keys of the examples that voted, nearest first.  A null text is empty, a
    null key is in no fold and no example; a key with several texts is one example, of the
    least.  Other columns are not looked at, whatever their names.  Without usable labels every
    score is the share of toxic examples (0.5 if there are none); an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, key, text, **options))
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = shared.value, {}
        for batch in batches:
            for s in K.slices(batch.column(1)):
                row, term, count = _counts(s, index.known)
                edges = np.searchsorted(row, np.arange(s.rows + 1))
                names, new = [], {}
                for i in range(s.rows):
                    t, n = term[edges[i]:edges[i + 1]], count[edges[i]:edges[i + 1]]
                    names.append(xxhash.xxh3_128_digest(t.tobytes() + n.tobytes()))
                    if len(t) and len(index.keys) and names[-1] not in seen:
                        new[names[-1]] = t, n
                for name, (best, value) in zip(new, index.nearest(list(new.values()))):
                    seen[name] = index.score(best, value), [index.keys[j] for j in best]
                bare = (index.none if len(index.keys) else index.rate), []
                scores, evidence = zip(*[seen.get(name, bare) for name in names])
                if len(seen) > 50_000:
                    seen.clear()
                keys = batch.column(0).slice(s.first, s.rows)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(scores, pa.float64()),
                     pa.array(evidence, pa.list_(keys.type))], ["key", "score", "evidence"])

    out = picked.mapInArrow(run, f"key {kind.simpleString()}, score double, "
                                 f"evidence array<{kind.simpleString()}>")
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
