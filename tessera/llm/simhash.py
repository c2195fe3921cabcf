"""SimHash near-duplicates with covering locality-sensitive hashing.

For radius r every fingerprint bit gets a non-zero vector of r + 1 bits, and each of the
2**(r + 1) - 1 non-zero vectors v makes a mask of the bits whose vector has odd inner product with
v. Any r bits leave some v orthogonal to all of theirs, so two fingerprints that differ in at most r
bits agree under the mask of that v: no pair within the radius is missed. Equal fingerprints are one
vertex; links run between different fingerprints only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buckets
from .common import appended, map_arrow, materialise, texts, with_columns
from .components import connected_components

_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_ONE_SPACE = bytes.maketrans(_SPACES, b" " * len(_SPACES))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CLEAN = bytes(_ONE_SPACE[b] if b in _SPACES else _LOWER[b] for b in range(256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of the word shingles, repeats included; one of all the words if there are no more than width."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    if not words:
        return np.empty(0, ">u8")
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], ">u8")
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - width + 1].tolist()
    return np.array([digest(line[a:b], 42) for a, b in zip(start, end[width - 1 :].tolist(), strict=True)], ">u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def masks(radius: int) -> list[int]:
    """The covering masks as unsigned 64-bit numbers."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + bit % n for bit in range(64)]
    return [sum(1 << bit for bit in range(64) if bin(vector[bit] & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with `fp`, the fingerprint as a signed long."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            return appended(batch, {"fp": pa.array([_signed(fingerprint(s, width)) for s in texts(batch)], pa.int64())})

        return fn

    return map_arrow(docs, make, with_columns(docs.schema, [("fp", T.LongType())]))


def fingerprint_links(prints: DataFrame, radius: int = 2, block: int = 1024) -> DataFrame:
    """prints(fp), distinct -> edges(src, dst) whose components are those of all pairs within the radius."""
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks(radius))]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    rows = buckets.dealt(rows, rows.select("bucket", "fp"), "fp", block).select("group", "side", "mixed", "fp")
    rows = rows.repartition("group").sortWithinPartitions("group")

    def run(batches):
        def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
            return {"group": b.column(0).to_numpy(), "side": b.column(1).to_numpy(), "mixed": b.column(2).to_numpy(zero_copy_only=False), "id": b.column(3).to_numpy()}

        for part in buckets.whole_groups(batches, columns):
            fp = part["id"].view(np.uint64)
            i, j = buckets.pairs_within(
                part,
                lambda a, b: np.bitwise_count(fp[a] ^ fp[b]) <= radius,  # noqa: B023
                lambda s: np.bitwise_count(fp[s, None] ^ fp[None, s]) <= radius,  # noqa: B023
            )
            yield buckets.linked_rows(part, i, j)

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")])
    found = rows.mapInArrow(run, schema)
    return found.select(F.col("root").alias("src"), F.col("node").alias("dst"))


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """prints(fp) -> (node, component) of every fingerprint linked with another."""
    return connected_components(fingerprint_links(prints.select("fp").distinct(), radius))


def simhash_groups(docs: DataFrame, radius: int = 2, width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document, and the carried columns.

    Null texts and texts without words have fingerprint zero. component_id is the least doc_id of
    the component; a null doc_id is a document that never names its component. Repeated rows give
    repeated results; an empty table gives an empty result.
    """
    slim = docs.select("doc_id", "text", *carry)
    rows = materialise(with_fingerprints(slim, width).drop("text"), "prints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = classes(least)
    named = least.join(linked, least.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialise(named, "named")
    head = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(head, "component").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(names, "fp").select("doc_id", digits, "component_id", *carry)
