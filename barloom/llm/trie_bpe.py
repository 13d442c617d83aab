"""BPE encoding over a trie of the distinct words, and decoding.

A word is a path of byte symbols; its last symbol is the byte with the word-end mark.  The
distinct words are inserted into a trie in order, so they are walked depth first.  A node's
state is the *last token* of the encoding of its path: the one vocabulary entry that ends there
and may follow the last token of the node where it starts.  That node is an ancestor, whose state
is known, so a prefix shared by any number of words is encoded once.  A word's ids are read back
from its end along those nodes.

Two tokens may follow each other if no merge reaches over their border.  A part on the edge of a
token is there until its own merge is due; a merge over the border is made if it is due before
either part is gone (equal merges go from left to right).

Memory and scale: every task has its own trie; there is no shuffle.  A trie of ``MAX_NODES`` nodes
is dropped and begun anew, so a task's memory does not follow its number of texts; words above
``LONG_WORD`` bytes keep their states in plain arrays.  A lost task is run again from its input.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

VOCABULARY = "word_bpe_49k"
MAX_NODES = 1 << 19
LONG_WORD = 1 << 14
OUT_BYTES = 1 << 22
NEVER = 1 << 60          # later than every merge
WORD_END = 256           # added to a byte that ends a word

# Texts of these characters need no Unicode normalisation and are cut by ``_FAST``, which gives the
# words of the vocabulary's own rule; other texts are cut by the tokenizer's own two first steps.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ſ]*")
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ \t\n\r{_LETTER}{_NUMBER}]+")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a word-end BPE file; ``path`` may be anywhere."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        size = 1 + max([*ids.values(), *(t["id"] for t in whole["added_tokens"])])
        self.tokens: list[str | None] = [None] * size
        for token, i in ids.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.of_symbol = {c: b for b, c in enumerate(byte_symbols())}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        made = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = ids[left], ids[right], ids[left + right]
            self.merge[a, b] = rank
            self.parts[c] = (a, b, rank)
            made.append(left + right)
        # only what merges can make, by its bytes: inside a word, and at its end
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token in [*self.of_symbol, *(c + self.end for c in self.of_symbol), *made]:
            if token not in ids:
                continue
            last = token.endswith(self.end)
            letters = token[:len(token) - len(self.end)] if last else token
            (self.final if last else self.inner)[bytes(map(self.of_symbol.get, letters))] = ids[token]
        self.longest = max(map(len, [*self.inner, *self.final]))
        self._may: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """No merge of the two tokens' parts reaches over their border."""
        known = self._may.get((a, b))
        if known is None:
            known = self._may[a, b] = not any(
                rank is not None and rank < gone_x and rank <= gone_y
                for x, gone_x in self._edge(a, 1) for y, gone_y in self._edge(b, 0)
                for rank in (self.merge.get((x, y)),))
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts on one edge of a token and the merge that uses each up."""
        out, gone = [(token, NEVER)], NEVER
        while token in self.parts:
            gone = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, gone))
        return out


class Trie:
    """States of all prefixes of the words inserted so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.start = array("i", [-1]), array("i", [-1])
        self.ids: dict[bytes, bytes] = {}

    def __len__(self) -> int:
        return len(self.last)

    def _state(self, word: bytes, depth: int, known: dict[bytes, int], path, last) -> tuple[int, int]:
        """(token, node it starts at): the one token that ends at ``depth`` and may stand there."""
        get, may = known.get, self.v.may_follow
        for size in range(min(depth, self.v.longest), 0, -1):
            token = get(word[depth - size:depth])
            if token is not None:
                node = path[depth - size]
                if depth == size or may(last[node], token):
                    return token, node
        raise ValueError("the vocabulary lacks a byte")

    def insert(self, words: list[bytes]) -> None:
        """Add words that are not in yet; they are walked in order, so depth first."""
        path, before = [0], b""
        child, last, start = self.child, self.last, self.start
        for word in sorted(words):
            if len(word) > LONG_WORD:
                self.ids[word] = self._long(word)
                continue
            end = len(word) - 1
            same = len(os.path.commonprefix((before[:len(path) - 1], word[:end])))
            del path[same + 1:]
            node = path[same]
            for depth in range(same, end + 1):
                final = depth == end
                edge = node << 9 | word[depth] + WORD_END * final
                to = child.get(edge)
                if to is None:
                    token, at = self._state(word, depth + 1, self.v.final if final else self.v.inner,
                                            path, last)
                    to = child[edge] = len(last)
                    last.append(token)
                    start.append(at)
                if final:
                    out = array("I")
                    while to:
                        out.append(last[to])
                        to = start[to]
                    self.ids[word] = out[::-1].tobytes()
                else:
                    path.append(to)
                    node = to
            before = word

    def _long(self, word: bytes) -> bytes:
        """The same states for one long word, on a path of its own."""
        last, start, path, n = array("i", [-1]), array("i", [-1]), range(len(word) + 1), len(word)
        for depth in range(1, n + 1):
            token, at = self._state(word, depth, self.v.final if depth == n else self.v.inner,
                                    path, last)
            last.append(token)
            start.append(at)
        out = array("I")
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1].tobytes()


class Codec:
    """Ids (little-endian unsigned 32-bit) of texts and texts of ids."""

    def __init__(self, path: str, max_nodes: int = MAX_NODES):
        from tokenizers import Tokenizer
        self.v, self.max_nodes = Vocabulary(path), max_nodes
        self.trie = Trie(self.v)
        whole = Tokenizer.from_file(path)
        self.normalize, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, self.v.special)) + ")")
        self.special_ids = {t: i.to_bytes(4, "little") for t, i in self.v.special.items()}

    def words(self, text: str) -> list[bytes]:
        if _PLAIN.fullmatch(text):
            return [w.encode() for w in _FAST.findall(text.lower())]
        symbol = self.v.of_symbol.__getitem__
        return [bytes(map(symbol, w)) for w, _ in self.cut(self.normalize(text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.trie) > self.max_nodes:
            self.trie.clear()
        known = self.trie.ids
        cut = []
        for text in texts:
            parts = self.special.split(text) if self.v.special else [text]
            cut.append([self.words(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        new = {w for parts in cut for words in parts[::2] for w in words} - known.keys()
        self.trie.insert(list(new))
        out = []
        for parts in cut:
            out.append(b"".join(b"".join(map(known.__getitem__, p)) if i % 2 == 0
                                else self.special_ids[p] for i, p in enumerate(parts)))
        return out

    def decode(self, ids: bytes) -> str:
        """Token strings joined by a space; ids that the vocabulary lacks are left out."""
        tokens, n = self.v.tokens, len(self.v.tokens)
        return " ".join([tokens[i] for i in array("I", ids) if i < n and tokens[i] is not None])


def _path(vocabulary: str) -> str:
    import public_tokenizers
    return vocabulary if os.sep in vocabulary else public_tokenizers.path(f"{vocabulary}.json")


def _run(docs: DataFrame, key: str, text: str, vocabulary: str, decode: bool) -> DataFrame:
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = picked.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(_path(vocabulary))
        for batch in batches:
            for s in K.slices(batch.column(1)):
                ids = codec.encode([str(s.text(i), "utf-8") for i in range(s.rows)])
                for a, b in _portions(ids):
                    part = ids[a:b]
                    cols = [batch.column(0).slice(s.first + a, b - a),
                            pa.array([len(x) // 4 for x in part], pa.int64()),
                            pa.array(part, pa.binary())]
                    if decode:
                        cols.append(pa.array([codec.decode(x) for x in part], pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        cols, ["k", "n_tokens", "ids", "decoded"][:len(cols)])

    schema = f"k {kind}, n_tokens bigint, ids binary" + ", decoded string" * decode
    return picked.mapInArrow(run, schema).withColumnRenamed("k", key)


def _portions(ids: list[bytes]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, x in enumerate(ids):
        held += len(x)
        if held > OUT_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(ids):
        yield first, len(ids)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids): the ids of every whole text, little-endian unsigned 32-bit.

    As the vocabulary's own tokenizer without added tokens: strings of special tokens inside a
    text get their ids.  ``vocabulary`` is a public vocabulary's name or a file's path.  One row
    per row, in any order; a null or empty text has no ids; null and repeated keys are kept as
    they are; other columns are not looked at.
    """
    return _run(docs, key, text, vocabulary, False)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text",
               vocabulary: str = VOCABULARY) -> DataFrame:
    """As :func:`encode_texts` with ``decoded``, the text that the ids decode to."""
    return _run(docs, key, text, vocabulary, True)


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids",
               vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, decoded): token strings of ids joined by a space, special tokens included.

    Null ids decode to the empty text; ids outside the vocabulary are left out.
    """
    picked = encoded.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    kind = picked.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(_path(vocabulary))
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in _portions([x or b"" for x in values]):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array([codec.decode(x or b"") for x in values[a:b]], pa.string())],
                    ["k", "decoded"])

    return picked.mapInArrow(run, f"k {kind}, decoded string").withColumnRenamed("k", key)
