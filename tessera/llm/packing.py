"""Harmonic packing of tokenised documents into fixed-length sequences.

A piece of length l belongs to class k = capacity // l: k such pieces fit one sequence. Every class
fills its sequences with exactly k pieces, each worker for itself. Pieces of capacity // classes
tokens or fewer are the last class, which is filled by size: a piece belongs to the sequence in
whose stretch of the worker's running sum of lengths it begins. Documents may be cut, so a document
first gives full sequences; its rest is cut where leaving it whole would pad more than `slack` of its
share, into reciprocals capacity // k, which fill their class exactly. What the workers' last,
incomplete sequences hold goes through the same step again with `fan` workers joined to one, until
one worker is left; the pieces that then remain, whose number depends on capacity and classes only,
are packed first-fit by decreasing length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import materialise, texts


def cut(n: int, capacity: int, classes: int, slack: float) -> list[int]:
    """Piece lengths for n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if k >= classes or share - rest <= slack * share:
            return [*out, rest]
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, capacity: int = 2048, classes: int = 64, slack: float = 0.04, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""
    fields = [("doc_id", docs.schema["doc_id"].dataType), *((n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    end = np.uint32(end_id).tobytes()

    def run(batches):
        encode = bpe.json_encoder(vocabulary, pattern)
        memo: dict[int, list[int]] = {}
        for batch in batches:
            out: list[tuple] = []
            ids: list[np.ndarray] = []
            for row, text in enumerate(texts(batch)):
                data = (encode(text) if text else b"") + end
                n, at = len(data) // 4, 0
                tail = n % capacity
                if tail not in memo:
                    memo[tail] = cut(tail, capacity, classes, slack)
                for length in [capacity] * (n // capacity) + memo[tail]:
                    part = data[4 * at : 4 * (at + length)]
                    out.append((row, at, length, zlib.crc32(part), n))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i4"))
                    at += length
            if not out:
                continue
            row, *rest = zip(*out, strict=True)
            arrays = [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in rest)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _fill(df: DataFrame, level: int, workers: int, capacity: int, classes: int, worker_bits: int) -> tuple[DataFrame, DataFrame]:
    """Full sequences of each (worker, class), and the pieces of the incomplete ones."""
    group, names = ("worker", "k"), df.columns
    order = ("tie", "row")
    so_far = F.sum("length").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    stretch = capacity - max(1, capacity // classes) + 1
    numbered = (
        df.withColumn("worker", F.pmod(F.xxhash64(F.lit(2 * level), "row"), F.lit(workers))).withColumn("tie", F.xxhash64(F.lit(2 * level + 1), "row"))
        .withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).withColumn("so_far", so_far)
        .withColumn("bin", F.when(F.col("k") < classes, F.floor(F.col("i") / F.col("k"))).otherwise(F.floor(F.col("so_far") / stretch)).cast("long"))
        .withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(*group))).withColumn("last", F.max("bin").over(Window.partitionBy(*group)))
    )
    full = F.when(F.col("k") < classes, (F.col("bin") + 1) * F.col("k") <= F.col("of")).otherwise(F.col("bin") < F.col("last"))
    before = Window.partitionBy(*group, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # level (4 bits) | class | worker | bin, whose width is checked
    bin_bits = 63 - 4 - classes.bit_length() - worker_bits
    if level > 14 or bin_bits < 16:
        raise ValueError("too many classes or workers for a sequence number of 63 bits")
    fits = F.when(F.col("bin") < (1 << bin_bits), F.col("bin")).otherwise(F.raise_error(F.lit("too many sequences for a worker: lower rows_per_worker")).cast("long"))
    number = F.lit(((level << classes.bit_length()) << worker_bits) << bin_bits) + F.col("k").cast("long") * (1 << (worker_bits + bin_bits)) + F.col("worker") * (1 << bin_bits) + fits
    done = numbered.where(full).withColumn("offset", F.sum("length").over(before) - F.col("length")).withColumn("sequence_id", number)
    return done.select(*names, "offset", "sequence_id"), numbered.where(~full).select(*names)


def _first_fit(capacity: int, schema: T.StructType):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        rooms: list[int] = []
        number, offset = [], []
        for length in table.column("length").to_pylist():
            at = next((i for i, room in enumerate(rooms) if room >= length), len(rooms))
            if at == len(rooms):
                rooms.append(capacity)
            number.append((15 << 59) + at)  # above every level of the classes
            offset.append(capacity - rooms[at])
            rooms[at] -= length
        table = table.append_column("offset", pa.array(offset, pa.int64())).append_column("sequence_id", pa.array(number, pa.int64()))
        return table.select(schema.names)

    return run


def pack(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, capacity: int = 2048, classes: int = 64, slack: float = 0.04, rows_per_worker: int = 40_000, fan: int = 64, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; no sequence holds more than capacity ids.

    A null or empty text is the end id alone; repeated rows are packed separately and spread over
    the workers like any others; a null doc_id stays null; other input columns are not read; an
    empty table gives an empty result.
    """
    rows = pieces(docs, vocabulary, pattern, end_id, capacity, classes, slack, with_ids)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    left = rows.withColumn("k", F.least(F.lit(classes), F.floor(F.lit(capacity) / F.col("length"))).cast("int"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    columns = [*names, "sequence_id", "offset"] + (["ids"] if with_ids else [])
    workers = max(32, -(-rows.count() // rows_per_worker))
    worker_bits, level, packed = workers.bit_length(), 0, None
    while True:
        done, rest = _fill(left, level, workers, capacity, classes, worker_bits)
        packed = done.select(*columns) if packed is None else packed.unionByName(done.select(*columns))
        if workers == 1:
            break
        left, workers, level = materialise(rest, "left"), -(-workers // fan), level + 1
    schema = T.StructType([rest.schema[n] for n in ["row", *names, *(["ids"] if with_ids else [])]] + [T.StructField("offset", T.LongType()), T.StructField("sequence_id", T.LongType())])
    last = rest.select(*schema.names[:-2], F.lit(0).alias("one")).groupBy("one").applyInArrow(_first_fit(capacity, schema), schema)
    return packed.unionByName(last.select(*columns))
