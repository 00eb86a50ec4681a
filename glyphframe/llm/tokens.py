"""Byte-level BPE of texts, shared by encoding (1) and packing (3)."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken

#: Fixed value: the pattern that splits text before the merges.
PATTERN = public_tokenizers.PATTERN

#: The same split in the standard library's syntax, which runs faster. Where one of UNLIKE is in a text, the two may
#: differ (numbers that are not decimal digits, separators that only one of them takes as white space).
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNLIKE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ‐-‧₠-₿]")


def ranks_of(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Texts -> their ids as packed native integers of one type code. It keeps nothing of the texts that it has seen."""

    def __init__(self, path: str, code: str) -> None:
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})
        self.code, self.exact = code, regex.compile(PATTERN)

    def words(self, text: str) -> list[str]:
        """The text's pre-tokens."""
        return (self.exact if _UNLIKE.search(text) else _FAST).findall(text)

    def encode(self, text: str) -> bytes:
        return array(self.code, self.bpe.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str, code: str) -> Encoder:
    return Encoder(path, code)


@lru_cache(maxsize=1)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; ids without a token are empty."""
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out
