"""Alignment of two tokenisations of the same texts by interval coalescing.

Vocabulary A is byte-level BPE (on a space and the text), vocabulary B is a piece model (which adds
the space itself).  Every token is the interval of bytes that it covers.  All tokens of both sides
are sorted by start with one ``lexsort``; the running maximum of their ends is taken, and where a
start reaches it a new *group* begins: the least stretches that both sides cut alike.  Inside the
groups the overlapping A-B pairs are expanded; a *link* is a pair whose intervals end together.

The texts of a slice lie end to end, and a text's end is an end of both sides, so one pass aligns
all of them.

Scale: texts are not shuffled.  How often an (A id, B id) pair is linked is counted per task
before the one small shuffle.  In a linked pair the bytes of one token end with the bytes of the
other, so the number of different pairs is bounded by the two vocabularies (324,297 for the given
files, ``pair_bound``), whatever the corpus; that bounded table goes to all tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tokens import VOCABULARY, Encoder
from .trie_bpe import byte_symbols

PIECES = "piece_bpe_32k"
COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint"
LINK_TYPE = "<u4"        # A id in the upper 16 bits, B id in the lower 16


class Ragged:
    """Byte strings by number, kept end to end."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(x) for x in strings] or [0], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)

    def take(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``ids`` end to end, and where each ends."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.at[ids] - (ends - size), size) + np.arange(total)], ends


def token_bytes_a(vocabulary: str = VOCABULARY) -> list[bytes]:
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        whole = json.load(f)
    of_symbol = {c: b for b, c in enumerate(byte_symbols())}
    out = [b""] * (1 + max([*whole["model"]["vocab"].values(), *(t["id"] for t in whole["added_tokens"])]))
    for token, i in whole["model"]["vocab"].items():
        if all(c in of_symbol for c in token):
            out[i] = bytes(map(of_symbol.get, token))
    return out


def token_bytes_b(model) -> list[bytes]:
    def of(i: int) -> bytes:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        if model.is_control(i) or model.is_unknown(i):
            return b""
        return piece.replace("▁", " ").encode()
    return [of(i) for i in range(model.get_piece_size())]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """Pairs in which the bytes of one token end with those of the other: no others are linked."""
    def endings(long: list[bytes], short: list[bytes], first: int) -> int:
        of: dict[bytes, int] = {}
        for x in short:
            of[x] = of.get(x, 0) + 1
        return sum(of.get(x[k:], 0) for x in long for k in range(first, len(x)))
    return endings(a, b, 0) + endings(b, a, 1)


def coalesce(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the A and the B tokens, given the ends of two gapless runs of intervals."""
    start = np.concatenate([a_end, b_end])
    start[:len(a_end)] = np.concatenate([[0], a_end[:-1]]) if len(a_end) else []
    start[len(a_end):] = np.concatenate([[0], b_end[:-1]]) if len(b_end) else []
    end = np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)) >= len(a_end), start))
    reached = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[:len(a_end)], group[len(a_end):]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all overlapping A-B pairs, A's order first."""
    a_start = np.concatenate([[0], a_end[:-1]]) if len(a_end) else a_end
    b_start = np.concatenate([[0], b_end[:-1]]) if len(b_end) else b_end
    first = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - first
    a = np.repeat(np.arange(len(a_end)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)


class Aligner:
    """Alignments of lists of texts."""

    def __init__(self, vocabulary: str = VOCABULARY, pieces: str = PIECES):
        import sentencepiece
        self.encode_a = Encoder(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path(f"{pieces}.model"))
        a, b = token_bytes_a(vocabulary), token_bytes_b(self.model)
        if max(len(a), len(b)) > 1 << 16:
            raise ValueError("ids must be below 65,536")
        self.a, self.b = Ragged(a), Ragged(b)
        self.decimal = Ragged([b"%d," % i for i in range(max(len(a), len(b)))])

    def _ids(self, texts: list[str]):
        """Ids of the texts and how many each has; none where a side's bytes are not the text's."""
        given = [" " + t if t else "" for t in texts]
        ids_a = [self.encode_a(t) for t in given]
        ids_b = [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]
        want = [t.encode() for t in given]
        none = np.zeros(0, np.uint32)

        def same(ids, table, right) -> bool:
            return table.take(ids)[0].tobytes() == right

        if not all(texts) or not (same(np.concatenate(ids_a), self.a, b"".join(want))
                                  and same(np.concatenate(ids_b), self.b, b"".join(want))
                                  and [int(self.a.size[x].sum()) for x in ids_a]
                                  == [int(self.b.size[x].sum()) for x in ids_b]
                                  == [len(w) for w in want]):
            for i, right in enumerate(want):
                if not right or not (same(ids_a[i], self.a, right) and same(ids_b[i], self.b, right)):
                    ids_a[i] = ids_b[i] = none
        return (np.concatenate(ids_a), np.array([len(x) for x in ids_a], np.int64),
                np.concatenate(ids_b), np.array([len(x) for x in ids_b], np.int64))

    def __call__(self, texts: list[str]):
        """Per text: n_a, n_b, n_groups, n_links, n_overlaps (arrays), groups and links (lists)."""
        a, n_a, b, n_b = self._ids(texts)
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        group_a, group_b = coalesce(a_end, b_end)
        x, y = overlaps(a_end, b_end)
        doc = np.repeat(np.arange(len(texts)), n_a)
        per_text = lambda d: np.bincount(d, minlength=len(texts)).astype(np.int64)
        together = a_end[x] == b_end[y]
        links = (a[x[together]].astype(LINK_TYPE) << np.uint32(16)) | b[y[together]].astype(LINK_TYPE)
        n_links = per_text(doc[x[together]])
        new = np.ones(len(a), bool)
        new[1:] = group_a[1:] != group_a[:-1]
        # decimal ids in the order group, side; the mark after each tells what comes next
        ids, group = np.concatenate([a, b]), np.concatenate([group_a, group_b])
        side = np.arange(len(ids)) >= len(a)
        order = np.lexsort((side, group))
        chars, ends = self.decimal.take(ids[order])
        mark = np.full(len(ids), ord(";"), np.uint8)
        if len(ids):
            alike = group[order][1:] == group[order][:-1]
            mark[:-1][alike] = np.where(side[order][1:] != side[order][:-1], ord("|"), ord(","))[alike]
        chars[ends - 1] = mark
        until = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        view = chars.tobytes()
        groups = [view[p:q - 1] if q > p else b"" for p, q in zip(until[:-1].tolist(), until[1:].tolist())]
        cut = np.concatenate([[0], np.cumsum(n_links)]).tolist()
        return ([n_a, n_b, per_text(doc[new]), n_links, per_text(doc[x])], groups,
                [links[p:q].tobytes() for p, q in zip(cut[:-1], cut[1:])])


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
          pieces: str = PIECES) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_overlaps, groups, links), one row per row.

    ``groups`` lists the decimal ids of each group, ``a1,a2|b1;a3|b2,b3``; ``links`` holds the
    linked id pairs in order (little-endian unsigned 32-bit, A id * 65,536 + B id).  Strings of
    special tokens are plain text.  A text that is null, empty, or that one side does not give
    back byte by byte has no tokens: zeros and empty values.  Null and repeated keys are rows like
    others; other columns are not looked at.
    """
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = picked.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary, pieces)
        for batch in batches:
            for s in K.slices(batch.column(1)):
                numbers, groups, links = aligner([str(s.text(i), "utf-8") for i in range(s.rows)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.rows), *map(pa.array, numbers),
                     pa.array([g.decode() for g in groups], pa.string()), pa.array(links, pa.binary())],
                    ["k", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups", "links"])

    return (picked.mapInArrow(run, f"k {kind}, {COUNTS}, groups string, links binary")
            .withColumnRenamed("k", key))


def link_counts(aligned: DataFrame, links: str = "links") -> DataFrame:
    """(link, n): how often each id pair is linked in all rows; null links count as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(0, LINK_TYPE), np.zeros(0, np.int64)
        for batch in batches:
            for s in K.slices(batch.column(0), 1 << 23):
                more, times = np.unique(np.frombuffer(s.data, LINK_TYPE), return_counts=True)
                both, where = np.unique(np.concatenate([seen, more]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n, times]), len(both)).astype(np.int64)
                seen = both
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n)], ["link", "n"])

    return (aligned.select(links).mapInArrow(run, "link bigint, n bigint")
            .groupBy("link").agg(F.sum("n").alias("n")))


def score_links(aligned: DataFrame, counts: DataFrame, links: str = "links") -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of ``links``.

    ``count_sum`` adds the counts of a row's links; ``n_best`` counts the links whose count is the
    highest that their B id has (ties included).  ``counts`` (see :func:`link_counts`) has at most
    ``pair_bound`` rows and is read by the driver.  Rows without links get zeros.
    """
    table = counts.toArrow()
    link, n = table["link"].to_numpy().astype(LINK_TYPE), table["n"].to_numpy()
    order = np.argsort(link)
    link, n = link[order], n[order]
    b = (link & np.uint32(0xFFFF)).astype(np.int64)
    top = np.zeros(1 << 16, np.int64)
    np.maximum.at(top, b, n)
    best = n == top[b]
    others = [f for f in aligned.schema.fields if f.name != links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(len(others)), 1 << 23):
                at = np.searchsorted(link, np.frombuffer(s.data, LINK_TYPE))
                sums = np.concatenate([[0], np.cumsum(n[at] if len(at) else at)])
                hits = np.concatenate([[0], np.cumsum(best[at] if len(at) else at)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(s.first, s.rows) for i in range(len(others))),
                     *(pa.array(np.diff(c[s.bounds // 4]).astype(np.int64)) for c in (hits, sums))],
                    [*(f.name for f in others), "n_best", "count_sum"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return aligned.select(*(f"`{f.name}`" for f in others), links).mapInArrow(
        run, f"{names}, n_best bigint, count_sum bigint")
