"""Byte-level BPE vocabularies and the cutting of texts into pieces that are tokenised alone."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import regex

#: Where the tokenizer files lie; every function takes the path as a parameter.
DEFAULT_VOCABULARY = os.environ.get("QUILLSPAN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The usual cutting rule of byte-level vocabularies of this size.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEFORE_WORD = re.compile(r" (?=\S)")


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=4)
def pattern_of(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@lru_cache(maxsize=4)
def encoder_of(raw: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(raw), special_tokens={})


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()[:16]


class _Irregular(Exception):
    """A piece that is no word after a single space."""


class PieceCache(dict):
    """piece -> value of " " + piece, bounded; the cutting rule never joins text across such a space.

    A space before a non-space always begins a new unit under PATTERN, so the pieces between such spaces
    can be tokenised alone. ``text.split(" ")`` gives them directly unless spaces repeat or stand before
    other white space; such texts are cut by a regular expression.
    """

    def __init__(self, value_of, most: int = 400_000):
        super().__init__()
        self.value_of, self.most = value_of, most

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace():
            raise _Irregular
        return self.store(piece, self.value_of(" " + piece))

    def store(self, piece: str, value):
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = value
        return value

    def values_of(self, text: str) -> list:
        """Values of all pieces of the text in order."""
        first, *rest = text.split(" ")
        try:
            return [self.value_of(first), *map(self.__getitem__, rest)] if first or not rest else self._cut(text)
        except _Irregular:
            return self._cut(text)

    def _cut(self, text: str) -> list:
        first, *rest = _BEFORE_WORD.split(text)
        return [self.value_of(first), *map(self.__getitem__, rest)]


@lru_cache(maxsize=2)
def _encoded_lengths(raw: bytes, pattern: str) -> PieceCache:
    encode = encoder_of(raw, pattern).encode_ordinary
    return PieceCache(lambda piece: len(encode(piece)))


def forget_lengths() -> None:
    _encoded_lengths.cache_clear()


def encoded_length(text: str, raw: bytes, pattern: str = PATTERN) -> int:
    """The number of tokens by the vocabulary's own encoder: that of ``token_counts``, for operators that only need numbers."""
    return sum(_encoded_lengths(raw, pattern).values_of(text))
