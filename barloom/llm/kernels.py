"""Numpy kernels over Arrow batches of texts, used inside Spark tasks.

A batch is cut into slices of about ``SLICE_BYTES`` of text (a longer text is one slice), so
the memory of a task does not depend on the number of rows in a batch.  Everything works on
the UTF-8 bytes of all texts of a slice at once; no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ADD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Slice:
    """Some consecutive texts of a batch: ``data`` bytes, ``bounds`` (rows + 1), first row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first
        self.rows = len(bounds) - 1

    def text(self, row: int) -> memoryview:
        return memoryview(self.data)[self.bounds[row]:self.bounds[row + 1]]


def slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (nulls count as empty) into slices."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, values = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + slice_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield Slice(data[offs[row]:offs[end]], offs[row:end + 1] - offs[row], row)
        row = end


def load8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as little-endian integers, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end)."""
    eight = load8(data)
    length = ends - starts
    h = mix((eight[starts] & _LOW[np.minimum(length, 8)]) + length.astype(np.uint64) * _ADD)
    rest, done = np.flatnonzero(length > 8), 8
    while len(rest):
        part = eight[starts[rest] + done] & _LOW[np.minimum(length[rest] - done, 8)]
        h[rest] = mix(h[rest] * _M2 + part + _ADD)
        done += 8
        rest = rest[length[rest] > done]
    return h


def word_bounds(s: Slice, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, ...]:
    """Starts and ends of all words of a slice and the row each belongs to."""
    if not len(s.data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~separator[s.data]
    first = np.zeros(len(s.data) + 1, dtype=bool)
    first[s.bounds] = True  # a text's first byte never continues a word
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(s.bounds, starts, side="right") - 1


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive values from each position that has as many."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = out * _M1 + h[j:j + n]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in time independent of ``width``."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def owners(keys: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive keys the position of the least (the leftmost if tied).

    The order uses the upper 40 bits; the lower 24 hold the position inside a block.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    block, out = (1 << 24) - width, []
    for a in range(0, n, block):
        part = keys[a:min(a + block, n) + width - 1]
        at = np.arange(len(part), dtype=np.uint64)
        least = sliding_min((part & ~np.uint64(0xFFFFFF)) | at, width)
        out.append((least & np.uint64(0xFFFFFF)).astype(np.int64) + a)
    return np.concatenate(out)


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), type=pa.int64())


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column with ``counts[i]`` of the values in row i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a list column (null lists are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar([], type=column.type))
    counts = np.zeros(len(column) + 1, dtype=np.int64)
    if len(column):
        counts[1:] = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), counts
