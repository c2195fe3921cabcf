"""Exact byte-pair encoding of whole texts with caches of spaced chunks.

The libraries split a text by a pattern and merge inside each match, so a text's ids are the
concatenation of its matches' ids. Where every space stands alone between other characters, no
match crosses a space other than at its own start; a text then splits at its spaces into chunks
that recur, and each worker keeps the ids of the chunks it has met. Any other text goes through
the pattern itself.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import regex

from .common import kept

# The same classes as the public pattern's \p{L}, \p{N} and \s, over the characters SAFE allows.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t\n\r"
FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Characters whose class could differ between Unicode versions or engines; such texts take the general way.
UNSAFE = re.compile("[^\t\n\r -~¡-¬®-ɏ]")
#: The byte-level pre-tokenizer that the fast path stands for, and the pattern it uses.
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks of more characters are encoded anew each time, so that a cache is bounded in bytes.
LONGEST = 64
_ODD_SPACE = re.compile(r" [ \n\r\t]|[\n\r\t] ")


def lone_spaces(text: str) -> bool:
    return _ODD_SPACE.search(text) is None


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def tiktoken_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table of a rank file, by id."""
    with open(path, "rb") as lines:
        rows = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines)]
    table = [b""] * (max(i for i, _ in rows) + 1)
    for i, token in rows:
        table[i] = token
    return table


@lru_cache(maxsize=2)
def json_encoding(path: str, pattern: str):
    """A merge engine for a byte-level JSON vocabulary, or None where ranks and the pattern can't stand for it.

    They can if the i-th merge makes the token with the i-th id after the 256 bytes, words carry no
    prefix or suffix, and the text is split as byte-level vocabularies do by default: by the public
    pattern and without a space put before it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, alphabet = spec["model"], byte_alphabet()
    vocab = model["vocab"]
    plain = (
        spec.get("normalizer") is None and model.get("type", "BPE") == "BPE" and model.get("dropout") is None
        and not any(model.get(k) for k in ("ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        and {k: v for k, v in (spec.get("pre_tokenizer") or {}).items() if k != "trim_offsets"} == PLAIN_SPLIT and pattern == PLAIN_PATTERN
    )
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
    if len(ranks) != 256 + len(merges) or len(set(ranks.values())) != len(ranks):
        return None
    return tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's own reading of a JSON vocabulary, single-threaded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


@lru_cache(maxsize=4)
def general(pattern: str):
    return regex.compile(pattern)


def split(text: str, pattern: str) -> list[str]:
    """Every match of the pattern, in order."""
    return FAST.findall(text) if UNSAFE.search(text) is None else general(pattern).findall(text)


class ChunkIds(dict):
    """chunk -> its ids after a space, as little-endian unsigned 32-bit bytes; emptied when full, long chunks are not kept."""

    def __init__(self, encode_ids, limit: int):
        super().__init__()
        self.encode_ids, self.limit = encode_ids, limit

    def __missing__(self, chunk: str) -> bytes:
        out = self.encode_ids(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = out
        return out


class JsonEncoder:
    """Texts to id bytes, exactly as the tokenizers library encodes them without special tokens added."""

    def __init__(self, path: str, pattern: str, limit: int = 600_000):
        from array import array

        self.special, self.path = added_tokens(path), path
        fast = json_encoding(path, pattern)
        self.fast = fast is not None
        self.chunks = ChunkIds((lambda s: array("I", fast.encode_ordinary(s)).tobytes()) if self.fast else self._slow, limit)

    def _slow(self, text: str) -> bytes:
        from array import array

        return array("I", library(self.path).encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.fast or UNSAFE.search(text) or any(s in text for s in self.special):
            return self._slow(text)
        if not lone_spaces(text):
            return self.chunks.encode_ids(text)
        first, *rest = text.split(" ")
        return self.chunks.encode_ids(first) + b"".join(map(self.chunks.__getitem__, rest))


def json_encoder(path: str, pattern: str) -> JsonEncoder:
    """One encoder a worker process, kept between tasks."""
    return kept(("json", path, pattern), lambda: JsonEncoder(path, pattern))
