"""Benchmark decontamination: SimHash of item-sized windows, verified by weighted shingles.

* Words are runs of letters and digits (ASCII case folded), so markup and punctuation put
  around a leaked passage do not hide it.
* A window that is similar to an item shares word shingles with it.  Positions whose shingle
  is a benchmark shingle say where item-sized windows have to be looked at; other windows
  have similarity 0 and need no fingerprint.
* Each such window gets a SimHash of its shingles.  Its fingerprint is looked up in a
  multi-index: 64 bits are cut into radius + 1 blocks, so every item fingerprint within the
  radius agrees in one block at least.
* The looked-up items are verified by the exact weighted Jaccard similarity of the shingle
  multisets.

The benchmark is the small side: it must not exceed ``MAX_ITEMS`` items of ``MAX_CHARS``
characters together, which is checked; a larger one is cut into several runs by the caller.
Documents stay where they are: nothing of them is shuffled before the matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19               # of 64 bits; at similarity 0.8 fewer than 1 in 1000 windows differ more
MAX_ITEMS = 200_000
MAX_CHARS = 64_000_000

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def folded_words(s: K.Slice) -> tuple[np.ndarray, ...]:
    """Folded bytes of a slice, and starts, ends and rows of its runs of letters and digits."""
    folded = K.Slice(_LOWER[s.data], s.bounds, s.first)
    return folded.data, *K.word_bounds(folded, _SEPARATOR)


def _tokens(s: K.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice and their rows, case folded."""
    data, starts, ends, rows = folded_words(s)
    return K.hash_runs(data, starts, ends), rows


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    return K.window_hashes(words, min(size, len(words))) if len(words) else words


def simhash(shingles: np.ndarray) -> int:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(shingles),
                           bitorder="little").view(np.uint64)[0])


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets: sum of minima over sum of maxima."""
    if not len(a) or not len(b):
        return 0.0
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(p, minlength=at.max() + 1) for p in (at[:len(a)], at[len(a):]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Item fingerprints by block, and where each benchmark shingle stands in its items."""

    def __init__(self, items: list[tuple[int, str | None]], shingle: int, radius: int):
        self.shingle, self.radius = shingle, radius
        self.ids, self.words, self.shingles = [], [], []
        texts = pa.array([t for _, t in items], type=pa.string())
        for s in K.slices(texts):
            h, rows = _tokens(s)
            for r in range(s.rows):
                words = h[rows == r]
                if len(words):
                    self.ids.append(items[s.first + r][0])
                    self.words.append(len(words))
                    self.shingles.append(_shingles(words, shingle))
        self.fp = np.array([simhash(x) for x in self.shingles], dtype=np.uint64)
        # seeds: (shingle length, shingle) -> items and places; items shorter than a shingle
        # are one shingle of their own length
        self.seeds = {}
        for n in sorted({min(shingle, w) for w in self.words}):
            own = [i for i, w in enumerate(self.words) if min(shingle, w) == n]
            hashes = np.concatenate([self.shingles[i] for i in own])
            item = np.repeat(own, [len(self.shingles[i]) for i in own])
            place = np.concatenate([np.arange(len(self.shingles[i])) for i in own])
            order = np.argsort(hashes, kind="stable")
            self.seeds[n] = hashes[order], item[order], place[order]
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(cuts, cuts[1:]):
            part = (self.fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            table: dict[int, list[int]] = {}
            for i, v in enumerate(part.tolist()):
                table.setdefault(v, []).append(i)
            self.blocks.append((int(low), (1 << int(high - low)) - 1,
                                {v: np.array(x) for v, x in table.items()}))

    def within(self, fp: int) -> np.ndarray:
        """All items whose fingerprint differs in ``radius`` bits at most."""
        hits = [t[v] for low, mask, t in self.blocks if (v := (fp >> low) & mask) in t]
        if not hits:
            return np.zeros(0, dtype=np.int64)
        found = np.unique(np.concatenate(hits))
        return found[np.bitwise_count(self.fp[found] ^ np.uint64(fp)) <= self.radius]

    def windows(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(start, length) of the item-sized windows that share a shingle with an item there."""
        out = set()
        lengths = np.array(self.words)
        for n, (hashes, item, place) in self.seeds.items():
            if len(words) < n:
                continue
            own = K.window_hashes(words, n)
            low = np.searchsorted(hashes, own, "left")
            count = np.searchsorted(hashes, own, "right") - low
            at = np.flatnonzero(count)
            if len(at):
                k = np.repeat(low[at], count[at]) + np.arange(count[at].sum()) - np.repeat(
                    np.cumsum(count[at]) - count[at], count[at])
                start = np.repeat(at, count[at]) - place[k]
                size = np.minimum(lengths[item[k]], len(words))
                start = np.clip(start, 0, len(words) - size)
                out.update(zip(start.tolist(), size.tolist()))
        return out

    def matches(self, words: np.ndarray, similarity: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, start, words) of the best window of every item found."""
        best: dict[int, tuple[float, int, int]] = {}
        for start, size in sorted(self.windows(words)):
            shingles = _shingles(words[start:start + size], self.shingle)
            for i in self.within(simhash(shingles)).tolist():
                value = weighted_similarity(shingles, self.shingles[i])
                if value >= similarity and value > best.get(i, (0.0,))[0]:
                    best[i] = value, start, size
        return [(self.ids[i], *best[i]) for i in sorted(best)]


class _Finder:
    """Finds the matches of the rows of a batch; built once per task."""

    def __init__(self, items, shingle: int, similarity: float, radius: int):
        self.index, self.similarity = Index(items, shingle, radius), similarity
        # one look tells most texts apart: 2^20 bits of all seed shingles
        self.maps = {}
        for n, (hashes, _, _) in self.index.seeds.items():
            self.maps[n] = np.zeros(1 << 20, bool)
            self.maps[n][hashes >> np.uint64(44)] = True

    def __call__(self, texts: pa.Array) -> Iterator[tuple]:
        for s in K.slices(texts):
            words, at = _tokens(s)
            hit = np.zeros(s.rows, bool)
            for n, bits in self.maps.items():
                own = K.window_hashes(words, n)
                hit[at[:len(own)][bits[own >> np.uint64(44)]]] = True
            edges = np.searchsorted(at, np.arange(s.rows + 1))
            for r in np.flatnonzero(hit).tolist():
                for m in self.index.matches(words[edges[r]:edges[r + 1]], self.similarity):
                    yield (s.first + r, *m)


def _bounded(benchmark: DataFrame, item: str, item_text: str):
    """The items, broadcast after their number and size were checked."""
    n, chars = benchmark.agg(F.count(F.lit(1)), F.sum(F.length(item_text))).first()
    if n > MAX_ITEMS or (chars or 0) > MAX_CHARS:
        raise ValueError("the benchmark is too large for one run: pass it in parts")
    rows = [tuple(r) for r in benchmark.select(item, item_text).collect()]
    return benchmark.sparkSession.sparkContext.broadcast(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", shingle: int = SHINGLE,
                 similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, item, similarity, start_word, n_words): every item a document contains.

    The best window per item is returned (the first of equal ones).  Null and empty texts,
    and items without words, match nothing.  Rows that repeat a key give rows each.
    """
    shared = _bounded(benchmark, item, item_text)
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = (picked.schema["key"].dataType.simpleString(),
             benchmark.schema[item].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(shared.value, shingle, similarity, radius)
        for batch in batches:
            cols = list(zip(*find(batch.column(1)))) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())),
                 pa.array(cols[1], pa.int64()) if kinds[1] == "bigint" else pa.array(cols[1]),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()),
                 pa.array(cols[4], pa.int64())],
                ["key", "item", "similarity", "start_word", "n_words"])

    found = picked.mapInArrow(run, f"key {kinds[0]}, item {kinds[1]}, similarity double, "
                                   "start_word bigint, n_words bigint")
    return found.withColumnsRenamed({"key": key, "item": item})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                      item: str = "item_id", item_text: str = "text", shingle: int = SHINGLE,
                      similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows that contain an item; one pass, no shuffle, all columns stay."""
    shared = _bounded(benchmark, item, item_text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(shared.value, shingle, similarity, radius)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[m[0] for m in find(batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
