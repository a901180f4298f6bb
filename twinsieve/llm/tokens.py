"""Byte-level BPE ids inside Spark tasks, with a per-worker memo of space-delimited chunks.

A chunk is a word with the space before it.  The published split pattern always
breaks before a space that follows a non-space or precedes a non-space, so such
chunks can be encoded on their own and looked up when they recur; texts where a
space stands between two white-space characters are encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np

from twinsieve.llm.common import Memo

UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Above this code point the two libraries may carry different Unicode tables.
LATIN_END = "ɏ"


class ChunkTokenizer:
    """``encode(text)`` gives the ids as little-endian bytes of ``dtype``; memory is bounded by ``memo_size`` chunks."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str, memo_size: int = 300_000):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._json_path, self._full = json_path, None
        top = max(ranks.values()) + 2
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._spaced = Memo(lambda c: self._chunk(" " + c), memo_size)

    @property
    def full(self):
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self._json_path)
            self._special = [t.content for t in self._full.get_added_tokens_decoder().values()]
        return self._full

    def _pack(self, ids) -> bytes:
        return array(self._code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.full.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) <= LATIN_END:
            return array(self._code, self._bpe.encode_ordinary(chunk)).tobytes()
        return self._whole(chunk)

    def encode(self, text: str) -> bytes:
        if "<|" in text or UNSAFE.search(text):
            return self._whole(text)
        parts = text.split(" ")
        return self._chunk(parts[0]) + b"".join(map(self._spaced.__getitem__, parts[1:]))


_LOADED: dict[tuple, ChunkTokenizer] = {}


def byte_bpe(json_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None) -> ChunkTokenizer:
    """The tokenizer of this worker; paths default to the installed public vocabulary files."""
    key = (json_path, ranks_path, pattern)
    if key not in _LOADED:
        import public_tokenizers as P

        _LOADED[key] = ChunkTokenizer(json_path or P.path("byte_bpe_50k.json"),
                                      ranks_path or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN)
    return _LOADED[key]
