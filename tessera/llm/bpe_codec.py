"""Byte-level BPE over a global shuffle of distinct words.

A block is what one task reads, up to `block_chars` of text. Each block numbers its distinct
pre-tokens, the frequent ones first; its documents become lists of these numbers, which say by
position what to put together again. The distinct pre-tokens go out in slices by a hash of the word:
equal words of all blocks meet in one slice, where each is encoded once, and the ids go back to the
block. There the documents are reassembled by position. Listing a word once a block rather than once
an occurrence keeps both shuffles far smaller than the text, and gives the most frequent word as many
entries as there are blocks, not occurrences. The text is read and split once: documents and words
leave in one exchange, which both sides of the join read. Decoding looks ids up in the token-byte
table, which has the vocabulary's size.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import texts

#: Numbers are compressed in parts of about so many.
_PART = 1 << 20
#: A task's blocks are numbered below this.
_TURNS = 1 << 24


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers below 2**31 as three compressed streams: seven bits, seven bits, the rest."""
    high = numbers >> 7
    streams = [np.where(high > 0, (numbers & 127) | 128, numbers).astype(np.uint8)]
    high = high[high > 0]
    more = high >> 7
    streams += [np.where(more > 0, (high & 127) | 128, high).astype(np.uint8), more[more > 0].astype("<u4")]
    data = [zstandard.compress(x.tobytes(), 3) for x in streams]
    return np.array([len(d) for d in data], "<u4").tobytes() + b"".join(data)


def unpacked(data: bytes) -> np.ndarray:
    """What packed() was given, as 64-bit numbers."""
    at, streams = 12, []
    for size in np.frombuffer(data, "<u4", 3).tolist():
        streams.append(zstandard.decompress(data[at : at + size]))
        at += size
    out, high = (np.frombuffer(x, np.uint8).astype(np.int64) for x in streams[:2])
    more = np.flatnonzero(high & 128)
    high[more] = (high[more] & 127) | np.frombuffer(streams[2], "<u4").astype(np.int64) << 7
    more = np.flatnonzero(out & 128)
    out[more] = (out[more] & 127) | high << 7
    return out


class _Block:
    """Distinct pre-tokens of a block, numbered as they come, and its documents as numbers."""

    def __init__(self, pattern: str, name: int):
        self.pattern, self.name, self.words, self.chunks, self.n_chars = pattern, name, {}, {}, 0
        self.ids, self.held = [], []

    def numbers(self, text: str) -> bytes:
        words = self.words
        return np.array([words.setdefault(w, len(words)) for w in bpe.split(text, self.pattern)], "<u4").tobytes()

    def add(self, doc_id, text: str | None) -> None:
        text = text or ""
        self.n_chars += len(text)
        if bpe.UNSAFE.search(text) or not bpe.lone_spaces(text):
            data = self.numbers(text)
        else:
            first, *rest = text.split(" ")
            chunks = self.chunks
            for c in rest:
                if c not in chunks:
                    chunks[c] = self.numbers(" " + c)
            data = self.numbers(first) + b"".join(map(chunks.__getitem__, rest))
        self.ids.append(doc_id)
        self.held.append(data)

    def rows(self, slices: int):
        """(to, slice, document ids, sizes, packed, mark): the words by slice, their numbers in that order, the documents."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        of = np.fromiter((zlib.crc32(w) % slices for w in words), np.int64, len(words))
        said = np.bincount(np.concatenate([np.frombuffer(x, "<u4") for x in self.held]), minlength=len(words)) if words else np.empty(0, np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-said, kind="stable")] = np.arange(len(words))
        order = sorted(range(len(words)), key=words.__getitem__)  # neighbours share beginnings, which compression uses
        order = np.array(order, np.int64)[np.argsort(of[order], kind="stable")] if words else np.empty(0, np.int64)
        # The mark goes with the words and the documents: two readings that differ do not match.
        digest = xxhash.xxh64()
        edge = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if words else []
        made = []
        for lo, hi in zip(edge, [*edge[1:], len(order)], strict=True):
            mine = [words[i] for i in order[lo:hi]]
            data = packed(np.fromiter(map(len, mine), np.int64, len(mine))), zstandard.compress(b"".join(mine), 3)
            digest.update(data[0])
            digest.update(data[1])
            made.append((int(of[order[lo]]), [len(mine), len(data[0])], data[0] + data[1]))
        mark = digest.intdigest() >> 1
        for at, sizes, data in made:
            yield -1 - at, at, None, sizes, data, mark
        yield self.name, -1, None, [len(order)], packed(rank[order]), mark
        lo, size = 0, np.fromiter((len(x) // 4 for x in self.held), np.int64, len(self.held))
        turn = (np.cumsum(size) - size) // _PART
        for at in range(len(size)):
            if at + 1 == len(size) or turn[at + 1] != turn[at]:
                numbers = np.frombuffer(b"".join(self.held[lo : at + 1]), "<u4")
                yield self.name, -2, self.ids[lo : at + 1], size[lo : at + 1].tolist(), packed(rank[numbers]), mark
                lo = at + 1


def _blocks(batches, pattern: str, block_chars: int):
    """The blocks of a task, each bounded by block_chars and one document, named by the task and its turn there."""
    name = TaskContext.get().partitionId() * _TURNS
    block = _Block(pattern, name)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            block.add(doc_id, text)
            if block.n_chars >= block_chars:
                yield block
                name += 1
                block = _Block(pattern, name)
    if block.ids:
        yield block


def _id_type(ranks: str) -> str:
    """The narrowest unsigned type for the vocabulary's ids between tasks."""
    return "<u2" if len(bpe.token_bytes(ranks)) <= 1 << 16 else "<u4"


def encode(docs: DataFrame, ranks: str, pattern: str, block_chars: int = 32_000_000, digests_only: bool = False) -> DataFrame:
    """doc_id, ids (array) and decoded (binary); with digests_only n_tokens, ids_sha256, decoded_sha256 instead.

    A null or empty text has no ids; rows equal in id and text give equal rows; other columns are
    not read; an empty table gives an empty result. Blocks are named by place, so equal ones stay
    apart. Tasks hold one block, or one slice of the distinct words; there are four slices for every
    partition of a shuffle, so spark.sql.shuffle.partitions sets the size of both.
    """
    spark = docs.sparkSession
    id_field = docs.schema["doc_id"]
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = T.StructType([T.StructField("to", T.LongType()), T.StructField("block", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("ids", T.ArrayType(id_field.dataType)),
                         T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType()), T.StructField("mark", T.LongType())])

    def split(batches):
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            to, at, ids, sizes, data, mark = zip(*rows, strict=True)
            columns = [pa.array(to, pa.int64()), pa.array([name] * len(to), pa.int64()), pa.array(at, pa.int32()), pa.array(ids, pa.list_(id_type)), pa.array(sizes, pa.list_(pa.int32())), pa.array(data, pa.binary()), pa.array(mark, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=sent.names)

        id_type = None

        def seen():
            nonlocal id_type
            for b in batches:
                id_type = b.column(0).type
                yield b

        for block in _blocks(seen(), pattern, block_chars):
            name, rows, held = block.name, [], 0
            for row in block.rows(slices):
                rows.append(row)
                held += len(row[4]) + 100
                if held > 1 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    def encoded(batches):
        enc, kind = bpe.tiktoken_encoding(ranks, pattern), _id_type(ranks)
        known: dict[bytes, bytes] = {}
        now = None
        for batch in batches:
            out = []
            for to, block, at, _, (n, head), data, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to != now:  # the sort brings a slice's rows together, so a word is encoded once and memory holds one slice
                    now = to
                    known.clear()
                length = unpacked(data[:head])
                flat, end = zstandard.decompress(data[head:]), np.cumsum(length)
                ids = []
                for lo, hi in zip((end - length).tolist(), end.tolist(), strict=True):
                    w = flat[lo:hi]
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(enc.encode_ordinary(w.decode("utf-8", "surrogatepass")), kind).tobytes()
                    ids.append(got)
                lens = packed(np.fromiter(map(len, ids), np.int64, n))
                out.append((block, at, [n, len(lens)], lens + zstandard.compress(b"".join(ids), 3), mark))
            if out:
                block, at, sizes, data, mark = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(at, pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(data, pa.binary()), pa.array(mark, pa.int64())], names=["to", "slice", "sizes", "packed", "mark"])

    both = docs.select("doc_id", "text").mapInArrow(split, sent).repartition("to")
    # A condition that the optimiser takes for random stays above the exchange, so that both sides read the same one.
    at = F.col("slice") + F.floor(F.rand(1))
    words = both.where(at >= 0).sortWithinPartitions("to")
    ids = words.mapInArrow(encoded, T.StructType([sent["to"], sent["slice"], sent["sizes"], sent["packed"], sent["mark"]]))
    numbered = both.where(at < 0)

    out = [T.StructField("doc_id", id_field.dataType)]
    if digests_only:
        out += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        out += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.BinaryType())]
    schema = T.StructType(out)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        differ = "the words and the documents of a block are of two different readings: the table changed in between"
        marks = set(left.column("mark").to_pylist()) | set(right.column("mark").to_pylist())
        at = left.column("slice").to_pylist()
        if len(marks) != 1 or at.count(-1) != 1:
            raise RuntimeError(differ)
        kind, one = np.dtype(_id_type(ranks)), at.index(-1)
        rank = unpacked(left.column("packed")[one].as_py())
        lens, flat = [np.empty(0, np.int64)], []
        for i in np.argsort(right.column("slice").to_numpy(), kind="stable").tolist():
            (_, head), data = right.column("sizes")[i].as_py(), right.column("packed")[i].as_py()
            lens.append(unpacked(data[:head]) // kind.itemsize)
            flat.append(zstandard.decompress(data[head:]))
        lens = np.concatenate(lens)
        if len(lens) != len(rank):
            raise RuntimeError(differ)
        tokens = np.frombuffer(b"".join(flat), kind).astype("<u4")
        length, start = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        length[rank], start[rank] = lens, np.cumsum(lens) - lens
        table = bpe.token_bytes(ranks)
        n, a, b, doc_ids = [], [], [], []
        for i in range(left.num_rows):
            if i == one:
                continue
            doc_ids.append(left.column("ids")[i].values)
            numbers, sizes = unpacked(left.column("packed")[i].as_py()), np.array(left.column("sizes")[i].as_py(), np.int64)
            end = np.cumsum(sizes)
            for lo, hi in zip((end - sizes).tolist(), end.tolist(), strict=True):
                said = numbers[lo:hi]
                mine = length[said]
                total = int(mine.sum())
                shift = np.repeat(start[said] - (np.cumsum(mine) - mine), mine)
                out_ids = tokens[shift + np.arange(total)] if total else np.empty(0, "<u4")
                text = b"".join(map(table.__getitem__, out_ids.tolist()))
                if digests_only:
                    n.append(total)
                    a.append(hashlib.sha256(out_ids.tobytes()).hexdigest())
                    b.append(hashlib.sha256(text).hexdigest())
                else:
                    a.append(out_ids.astype("i8"))
                    b.append(text)
        doc_ids = pa.chunked_array(doc_ids)
        if digests_only:
            return pa.table([doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)
        return pa.table([doc_ids, pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.binary())], names=schema.names)

    return numbered.groupBy("to").cogroup(ids.groupBy("to")).applyInArrow(joined, schema)


def decode(ids: DataFrame, ranks: str, column: str = "ids") -> DataFrame:
    """Any table with an id array column, with `decoded` bytes appended by a look-up in the token-byte table."""
    from .common import appended, map_arrow, with_columns

    def make():
        table = bpe.token_bytes(ranks)

        def fn(batch):
            rows = batch.column(batch.schema.get_field_index(column)).to_pylist()
            return appended(batch, {"decoded": pa.array([None if r is None else b"".join(table[i] for i in r) for r in rows], pa.binary())})

        return fn

    return map_arrow(ids, make, with_columns(ids.schema, [("decoded", T.BinaryType())]))
