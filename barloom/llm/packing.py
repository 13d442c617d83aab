"""Packing by the sum-of-squares rule.

Documents (their ids and an end id) come one by one.  Whole sequences are cut off a long
document; what remains goes into the partially filled window whose level makes the sum over
all levels of (number of windows at that level) squared smallest.  The numbers are kept in an
array over levels, so a document costs one look at that array, whatever was packed before.

Every task packs its own stream; sequences of tasks never mix, so there is no shuffle and a
lost task is packed again from its input.  At most ``MAX_OPEN`` windows are open: at that
number, and at the end, open windows are closed by joining their contents in order and
cutting them into full sequences.  The last rest of a task is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tokens import VOCABULARY, Encoder

LENGTH = 1024
END_ID = 0
MAX_OPEN = 4096          # windows a task holds; 16 MB of ids

SCHEMA = ("row bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
Piece = tuple[int, int, np.ndarray, int]  # row, start, ids, tokens of the document


class SumOfSquares:
    """Online packer of one stream; yields lists of pieces, each list a sequence."""

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN):
        self.length, self.max_open = length, max_open
        self.count = np.zeros(length + 1, np.int64)      # the level array
        self.open: dict[int, list[list[Piece]]] = {}
        self.held = 0

    def level(self, size: int) -> int:
        """The level (0: a new window) with the smallest sum of squares after placing."""
        fits = self.count[1:self.length - size + 1]
        # moving a window from h to h + size changes the sum by 2 (n[h+size] - n[h]) + 2;
        # a full window leaves the sum, a new one adds 2 n[size] + 1
        change = 2 * (self.count[1 + size:self.length + 1] - fits) + 2
        if size < self.length and len(change):
            change[-1] = 1 - 2 * fits[-1]                # fills its window
        change = np.where(fits > 0, change, np.iinfo(np.int64).max)
        new = 2 * self.count[size] + 1
        if len(change):
            best = int(np.argmin(change))
            if change[best] < new or (change[best] == new and fits[best] > 0):
                return best + 1
        return 0

    def place(self, row: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        n = len(ids)
        whole = n - n % self.length
        for a in range(0, whole, self.length):
            yield [(row, a, ids[a:a + self.length], n)]
        size = n - whole
        if not size:
            return
        piece = (row, whole, ids[whole:], n)
        h = self.level(size)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
            window.append(piece)
        else:
            window = [piece]
            self.held += 1
        h += size
        if h == self.length:
            self.held -= 1
            yield window
            return
        self.open.setdefault(h, []).append(window)
        self.count[h] += 1
        if self.held >= self.max_open:
            yield from self.close(last=False)

    def close(self, last: bool = True) -> Iterator[list[Piece]]:
        """Join the open windows, fullest first, into full sequences and a rest."""
        pieces = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        self.open, self.held = {}, 0
        self.count[:] = 0
        total = sum(len(p[2]) for p in pieces)
        sizes = [self.length] * (total // self.length)
        rest = total % self.length
        if last:
            sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        elif rest:
            sizes.append(rest)
        at = 0
        for size in sizes:
            window, room = [], size
            while room:
                row, start, ids, n = pieces[at]
                take = ids[:room]
                window.append((row, start, take, n))
                room -= len(take)
                if len(take) == len(ids):
                    at += 1
                else:
                    pieces[at] = (row, start + len(take), ids[len(take):], n)
            if size == rest and not last:
                self.open[size], self.count[size], self.held = [window], 1, 1
            else:
                yield window


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
         end_id: int = END_ID, vocabulary: str = VOCABULARY,
         max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit, binary),
    doc_tokens, sequence_id, offset.

    Ids are those of the vocabulary's own tokenizer: the string of a special token inside a text
    gets its id.  A null or empty text is a document of the end id alone.  Rows that repeat a key are
    documents of their own.  Sequence ids are unique, not dense.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    picked = docs.select(F.col(key).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, special_as_text=False)
        packer = SumOfSquares(length, max_open)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        end, rows, held = np.array([end_id], np.uint32), [], 0

        def out():
            cols = list(zip(*rows)) or [()] * 7
            kinds = [picked_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def add(windows):
            nonlocal sequence, held
            for window in windows:
                offset = 0
                for row, start, ids, n in window:
                    rows.append((row, start, len(ids), ids.astype("<u4").tobytes(), n, sequence,
                                 offset))
                    offset += len(ids)
                sequence += 1
                held += offset

        picked_type = pa.int64()
        for batch in batches:
            picked_type = batch.column(0).type
            for s in K.slices(batch.column(1)):
                keys = batch.column(0).slice(s.first, s.rows).to_pylist()
                for i, row in enumerate(keys):
                    ids = np.concatenate([encode(str(s.text(i), "utf-8")), end])
                    add(packer.place(row, ids))
                if held > 1 << 20:
                    yield out()
                    rows.clear()
                    held = 0
        add(packer.close())
        yield out()

    kind = picked.schema["row"].dataType.simpleString()
    return (picked.mapInArrow(run, SCHEMA.replace("row bigint", f"row {kind}"))
            .withColumnRenamed("row", key))
