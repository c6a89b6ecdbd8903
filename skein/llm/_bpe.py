"""Ids of a byte-level BPE tokenizer, as the tokenizers library gives them, through a cache of pre-tokens.

A text of well-known characters (below) is split by the tokenizer's own pattern, and each pre-token's ids come from a
cache; any other text goes to the tokenizers library whole. The special string is cut out first, as the library does.
"""

from __future__ import annotations

import base64
import re

import numpy as np

#: Characters whose classes are the same in every Unicode version; the pattern is the tokenizer's, spelt for them.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_ODD = re.compile("[^\\t-\\r\\x20-\\x7e¡-ɏ‐-‧‰-⁞€]")
_SPLIT = re.compile(rf" ?[{_LETTER}]++| ?[{_NUMBER}]++|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTER}{_NUMBER}]++|\s+(?!\S)|\s+")
CACHE = 300_000
LONGEST = 48


class _Cache(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """ids(text): the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_json: str, ranks_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_json)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.whole.get_added_tokens_decoder().items()}
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.words = _Cache(own.encode_ordinary)

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.special) == 1:
            (mark, code), = self.special.items()
            if mark in text:
                return code.join(b"".join(map(self.words.__getitem__, _SPLIT.findall(part))) for part in text.split(mark))
        elif any(mark in text for mark in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, _SPLIT.findall(text)))
