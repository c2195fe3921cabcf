"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their token lengths: the vocabulary's own
whole words, which are what its merges found frequent. Its size is the vocabulary's and it is
broadcast. Tier two is each worker's cache of white-space chunks; what neither holds is encoded by
the library. No pre-token is ever shuffled and the documents pass once, without exchange.

No match of the vocabulary's split holds white space and no normalisation reaches over a space, so
chunks are counted one by one; a chunk with a character outside the Latin blocks, or one whose lower
case is outside them, goes to the library as it stands, and a text with a special token's string
goes there whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import appended, kept, map_arrow, texts, with_columns

# The vocabulary's own split, over the characters bpe.UNSAFE lets through, after lower-casing.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{bpe._L}]+|[{bpe._N}]|[^{bpe._S}{bpe._L}{bpe._N}]+")
#: Characters of the safe blocks whose lower case is not in them: the pattern above would take those for signs.
_LEAVING = "".join(c for c in map(chr, range(0x250)) if not bpe.UNSAFE.search(c) and bpe.UNSAFE.search(c.lower()))
UNSAFE = re.compile(f"{bpe.UNSAFE.pattern}|[{_LEAVING}]")
_CHUNKS = re.compile(r"[^ \t\n\r]+")
_WORD_END = "</w>"


def frequent_lengths(path: str) -> dict[str, int]:
    """Token lengths of the vocabulary's whole words, as the library gives them."""
    tok, alphabet, words = bpe.library(path), bpe.byte_alphabet(), []
    for token in tok.get_vocab():
        if token.endswith(_WORD_END):
            try:
                word = bytes(alphabet[c] for c in token[: -len(_WORD_END)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if not bpe.UNSAFE.search(word) and _PIECES.findall(word) == [word]:
                words.append(word)
    return dict(zip(words, (len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)), strict=True))


class Lengths(dict):
    """White-space chunk -> number of tokens; emptied when full, long chunks are not kept."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int):
        super().__init__()
        self.tok, self.frequent, self.limit, self.special = bpe.library(path), frequent, limit, bpe.added_tokens(path)

    def encoded(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> int:
        if UNSAFE.search(chunk):
            n = self.encoded(chunk)
        else:
            n = 0
            for piece in _PIECES.findall(chunk.lower()):
                known = self.frequent.get(piece)
                n += self.encoded(piece) if known is None else known
        if len(chunk) <= bpe.LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return self.encoded(text)
        if UNSAFE.search(text):
            return sum(map(self.__getitem__, _CHUNKS.findall(text)))
        return sum(map(self.__getitem__, text.lower().split()))


def token_counts(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, cache_limit: int = 500_000) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit for the whole text.

    Null and empty texts have 0 bytes and tokens; equal rows get equal counts; an empty table gives
    an empty result; input columns named like a result column are replaced.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(vocabulary))
    extra = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]

    def make():
        count = kept(("lengths", vocabulary), lambda: Lengths(vocabulary, table.value, cache_limit)).count

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = texts(batch)
            n = [count(s) for s in rows]
            return appended(batch, {
                "n_bytes": pa.array([len(s.encode()) if s else 0 for s in rows], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > max_tokens for x in n], pa.bool_()),
            })

        return fn

    return map_arrow(docs, make, with_columns(docs.schema, extra))
