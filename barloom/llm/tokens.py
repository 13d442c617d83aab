"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k"
END_OF_TEXT = 50256
# Latin texts are encoded through the rank file of the same vocabulary, which gives the same
# ids several times faster; the two libraries' Unicode tables might differ elsewhere.
_LATIN = re.compile("[\x00-\x7e\xa1-ſ]*")
_LONG_GAP = re.compile(r"\s{2000}")  # a run the faster library may not be able to split


class Encoder:
    """Ids of whole texts, no special tokens added.

    ``special_as_text``: strings of special tokens inside a text are ordinary text (so an id of
    theirs separates documents without doubt); otherwise they get their ids, as the vocabulary's
    own tokenizer gives them.
    """

    def __init__(self, vocabulary: str = VOCABULARY, special_as_text: bool = True):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.tokenizer.encode_special_tokens = special_as_text
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = None if special_as_text or not marks else re.compile("|".join(map(re.escape, marks)))
        self.fast = None
        try:
            import tiktoken
        except ImportError:
            return
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if (self.fast is not None and _LATIN.fullmatch(text) and not _LONG_GAP.search(text)
                and not (self.marks and self.marks.search(text))):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
