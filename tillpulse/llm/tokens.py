"""Token ids of the public byte-level vocabulary, encoded chunk by chunk with a cache.

A chunk is a run of white space with the visible characters behind it. The vocabulary's pattern never lets a piece
reach from a visible character into white space, so chunks can be encoded one by one; the same chunk always gets the
same ids. A text in which a visible run ends in white space that the chunk pattern does not know is encoded whole.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
CACHE_ENTRIES = 300_000
_CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")


class ChunkEncoder(dict):
    """chunk -> its ids as little-endian 16-bit bytes; None if the text must be encoded whole."""

    def __init__(self, vocabulary: str = VOCABULARY):
        super().__init__()
        lines = open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb")
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = vocabulary
        self.full = None

    def whole(self, text: str) -> bytes:
        """Ids by the tokenizer file itself, which also knows the special token."""
        if self.full is None:
            self.full = Tokenizer.from_file(public_tokenizers.path(f"{self.vocabulary}.json"))
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def __missing__(self, chunk: str):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        # Only the last character can join what follows.
        if chunk[-1].isspace() and chunk[-1] not in " \n\t\r" or SPECIAL in chunk:
            ids = None
        else:
            ids = np.array(self.fast.encode_ordinary(chunk), "<u2").tobytes()
        if len(chunk) <= 100:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of ``text``, two bytes each."""
        try:
            return b"".join(map(self.__getitem__, _CHUNK.findall(text)))
        except TypeError:  # a chunk without ids of its own
            return self.whole(text)


@lru_cache(maxsize=None)
def encoder(vocabulary: str = VOCABULARY) -> ChunkEncoder:
    return ChunkEncoder(vocabulary)
