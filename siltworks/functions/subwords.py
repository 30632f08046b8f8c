"""Public tokenizer vocabularies, opened in workers from a folder that is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder with the vocabulary files; spark conf siltworks.tokenizers or this default.
DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def folder(spark) -> str:
    return spark.conf.get("siltworks.tokenizers", DEFAULT_DIR)


@lru_cache(maxsize=2)
def byte_bpe(at: str, name: str = "byte_bpe_50k.tiktoken"):
    """The byte-level vocabulary as a tiktoken encoding."""
    import tiktoken

    with open(os.path.join(at, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Subwords:
    """A vocabulary behind a few methods that any tokenizer has: encode, decode, count and its size; the way to
    pass another one where a function takes a tokenizer."""

    def __init__(self, enc) -> None:
        self.enc = enc

    @property
    def size(self) -> int:
        return self.enc.n_vocab

    def encode(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one that is out of range is an error, bytes that are no UTF-8 are replaced."""
        if any(not 0 <= i < self.size for i in ids):
            raise ValueError("an id is no token")
        return self.enc.decode(ids, errors="replace")

    def count(self, text: str) -> int:
        return len(self.encode(text))
