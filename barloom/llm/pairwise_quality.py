"""Quality by Bradley-Terry ranking of preference pairs.

Every text is described by a few numbers.  Pairs of a good and a poor example say which text
is preferred; the weights minimise the logistic loss on the difference of the two texts'
numbers (Newton steps, with a small penalty).  A document's score is its weighted sum; the
threshold is a quantile of the examples' scores: the share of poor ones.  Scores are mapped
to 0..1 so that the threshold lies at ``THRESHOLD``.

The examples are a bounded sample of the labelled rows; texts are scored where they are,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import EXAMPLES, examples, held_out

THRESHOLD = 0.7
PAIRS = 40_000           # preference pairs made from the examples, at most
PENALTY = 1e-2
FEATURES = ("log_words", "few_words", "word_length", "upper", "digits", "marks", "exclamations",
            "bars", "symbols", "repeats", "distinct", "lines")

_CLASS = {name: np.zeros(256, np.int64) for name in ("upper", "digits", "marks", "exclamations",
                                                     "bars", "symbols", "lines")}
for _name, _bytes in (("upper", range(65, 91)), ("digits", range(48, 58)), ("marks", b".,;:?"),
                      ("exclamations", b"!"), ("bars", b"|"), ("symbols", b"#*$%&<>"),
                      ("lines", b"\n")):
    _CLASS[_name][list(_bytes)] = 1


def features(s: K.Slice) -> np.ndarray:
    """One row of numbers per text of a slice."""
    starts, ends, rows = K.word_bounds(s)
    h = K.hash_runs(s.data, starts, ends)
    edges = np.searchsorted(rows, np.arange(s.rows + 1))
    words = np.diff(edges)
    per_word = np.maximum(words, 1)
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    sums = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    pairs = np.unique(K.mix(h) ^ K.mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    distinct = np.bincount(rows[pairs], minlength=s.rows)
    n = {c: sums(t[s.data], s.bounds) for c, t in _CLASS.items()}
    length = sums(ends - starts, edges)
    share = {c: v / np.maximum(length, 1) for c, v in n.items()}
    root = np.sqrt
    return np.column_stack([
        np.log1p(words), np.maximum(0, 12 - words) / 12, length / per_word, root(share["upper"]),
        root(share["digits"]), root(share["marks"]), root(share["exclamations"]),
        root(share["bars"]), root(share["symbols"]), root(sums(same, edges) / per_word),
        distinct / per_word ** 0.75, root(n["lines"] / per_word)]).astype(float)


def preference_weights(good: np.ndarray, poor: np.ndarray, pairs: int = PAIRS) -> np.ndarray:
    """Weights that minimise the logistic loss on good minus poor over preference pairs.

    Every poor example meets good ones in turn, and every good one meets a poor one.
    """
    n = max(1, min(pairs, max(len(good), len(poor)) * 8))
    i = np.arange(n)
    d = good[i % len(good)] - poor[(i * 7 + i // len(good)) % len(poor)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))       # chance of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + PENALTY * np.eye(len(w)),
                               d.T @ p / n - PENALTY * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Standardised weights, and the map of raw scores to 0..1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.sd = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
        self.w, self.cut, self.slope = np.zeros(len(FEATURES)), 0.0, 1.0
        if len(y) and 0 < y.sum() < len(y):
            self.mean, self.sd = x.mean(0), np.maximum(x.std(0), 1e-9)
            z = (x - self.mean) / self.sd
            self.w = preference_weights(z[y == 1], z[y == 0])
            raw = z @ self.w
            # the quantile that leaves as many below as there are poor examples
            low = np.sort(raw)
            at = int((y == 0).sum())
            self.cut = float((low[at - 1] + low[at]) / 2)
            self.slope = 1 / max(float(np.abs(raw - self.cut).mean()), 1e-9) * 2

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.sd) @ self.w - self.cut
        odds = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + odds, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str,
        rows: int = EXAMPLES) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(2)):
                x = features(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows), batch.column(1).slice(s.first, s.rows),
                     K.lists(pa.array(x.ravel()), np.full(s.rows, x.shape[1]))], ["key", "y", "x"])

    train = examples(docs, labels, label, key, text, rows)
    kind = train.schema["key"].dataType.simpleString()
    got = sorted((tuple(r) for r in train.mapInArrow(
        run, f"key {kind}, y int, x array<double>").collect()))
    x = np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    return Model(x, np.array([r[1] for r in got], int))


def score_texts(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
                text: str = "text", threshold: float = THRESHOLD,
                rows: int = EXAMPLES) -> DataFrame:
    """(key, held_out, score, predicted) of every row; a null text is an empty one.

    Without examples of both labels every score is the threshold.
    """
    model = fit(docs, labels, label, key, text, rows)
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows), pa.array(model.score(features(s)))],
                    ["key", "score"])

    kind = picked.schema["key"].dataType.simpleString()
    out = picked.mapInArrow(run, f"key {kind}, score double")
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
