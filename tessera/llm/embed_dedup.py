"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors are one vertex with a weight. Each table takes the signs of `bits` random projections
as a bucket; the number of bits grows with the logarithm of the vectors, so that buckets stay of
about `per_bucket` random vectors, and the number of tables is what makes a pair at the threshold
meet in none with probability `miss` at most. Only a sketch of signs travels to the buckets: pairs
whose signs differ in more places than a pair at the threshold does, but for `sketch_miss` of them,
go no further. The vectors of what is left then come to their buckets, and cosines are in double
precision. A pair that meets in several tables counts in the first.

Tables against the probability of a miss, for 8 bits and a threshold of 0.9: 14 at 1e-2, 21 at 1e-3,
27 at 1e-4, 34 at 1e-5.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buckets, vectors
from .common import materialise
from .components import connected_components


#: Signs in a sketch.
SKETCH = 256


def plan(n: int, threshold: float, miss: float, per_bucket: int) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(30, max(6, round(math.log2(max(n, 1) / per_bucket + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _codes(bits: int, tables: int, seed: int):
    planes: dict[int, np.ndarray] = {}
    power = 1 << np.arange(bits, dtype=np.int64)

    def codes(matrix: np.ndarray) -> np.ndarray:
        n = matrix.shape[1]
        if n not in planes:
            planes[n] = np.random.default_rng([seed, n]).standard_normal((n, bits * tables))
        signs = (vectors.unit(matrix) @ planes[n] > 0).reshape(len(matrix), tables, bits)
        return (signs @ power).astype(np.int32)

    return codes


def most_apart(signs: int, threshold: float, miss: float) -> int:
    """In how many of so many random signs a pair at the threshold differs, exceeded with probability miss at most."""
    p, n = math.acos(threshold) / math.pi, signs
    below, chance = 0.0, [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    for k in range(n + 1):
        below += chance[k]
        if 1 - below <= miss:
            return k
    return n


def links(distinct: DataFrame, threshold: float, miss: float, sketch_miss: float, per_bucket: int, block: int, seed: int) -> DataFrame:
    """distinct(node, n, embedding) -> (node, links, root), a row for each group where a node is linked."""
    bits, tables = plan(distinct.count(), threshold, miss, per_bucket)
    signs = min(SKETCH, bits * tables)
    apart = most_apart(signs, threshold, sketch_miss)
    kind = "<f4" if distinct.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"

    def coded(batches):
        codes = _codes(bits, tables, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            out, size = np.zeros((batch.num_rows, tables), np.int32), np.zeros(batch.num_rows, np.int32)
            for at, matrix in vectors.by_length(batch.column(2)):
                out[at], size[at] = codes(matrix), matrix.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            one = (out[:, :, None] >> np.arange(bits, dtype=np.int32) & 1).reshape(len(out), -1)[:, :signs].astype(np.uint8)
            sketch = np.zeros((len(out), SKETCH // 8), np.uint8)
            packed = np.packbits(one, axis=1)
            sketch[:, : packed.shape[1]] = packed
            columns = [batch.column(0), batch.column(1), pa.array(size), lists, pa.array([r.tobytes() for r in sketch], pa.binary()), vectors.pack(batch.column(2), kind)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.BinaryType()), T.StructField("packed", T.BinaryType())])
    rows = materialise(distinct.mapInArrow(coded, schema), "codes")
    bucket = F.xxhash64("size", "t", "code").alias("bucket")
    light = rows.select("node", "size", F.posexplode("codes").alias("t", "code")).select(bucket, "node")
    thin = rows.select("node", "size", "sketch", F.posexplode("codes").alias("t", "code")).select(bucket, "t", "node", "sketch")
    thin = buckets.dealt(thin, light, "node", block).select("group", "side", "mixed", "node", "t", "sketch")
    thin = thin.repartition("group").sortWithinPartitions("group")

    def sketched(batches):
        def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
            _, sketch = next(vectors.by_packed(b.column(5), "<u8", "u8"))
            return {"group": b.column(0).to_numpy(), "side": b.column(1).to_numpy(), "mixed": b.column(2).to_numpy(zero_copy_only=False), "id": b.column(3).to_numpy(), "t": b.column(4).to_numpy(), "sketch": sketch}

        for part in buckets.whole_groups(batches, columns):
            sketch = part["sketch"]
            near = lambda a, b: np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= apart  # noqa: B023, E731
            square = lambda s: sum(np.bitwise_count(w[s, None] ^ w[None, s]).astype(np.int16) for w in sketch.T) <= apart  # noqa: B023, E731
            i, j = buckets.pairs_within(part, near, square)
            at = np.unique(np.r_[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(part[c][at]) for c in ("group", "side", "mixed", "id", "t")], names=maybe.names)

    maybe = T.StructType([T.StructField("group", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("mixed", T.BooleanType()), T.StructField("node", T.LongType()), T.StructField("t", T.IntegerType())])
    left = materialise(thin.mapInArrow(sketched, maybe), "candidates")
    full = left.join(rows.select("node", "n", "packed"), "node").select(*maybe.names, "n", "packed").repartition("group").sortWithinPartitions("group")

    def run(batches):
        codes_of = _codes(bits, tables, seed)

        def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = {"group": b.column(0).to_numpy(), "side": b.column(1).to_numpy(), "mixed": b.column(2).to_numpy(zero_copy_only=False), "id": b.column(3).to_numpy(), "t": b.column(4).to_numpy(), "n": b.column(5).to_numpy()}
            unit, codes = np.empty(b.num_rows, object), np.zeros((b.num_rows, tables), np.int32)
            for at, matrix in vectors.by_packed(b.column(6), kind):
                codes[at] = codes_of(matrix)
                for k, row in zip(at, vectors.unit(matrix), strict=True):
                    unit[k] = row
            return out | {"unit": unit, "codes": codes}

        for part in buckets.whole_groups(batches, columns):
            unit, codes, table = part["unit"], part["codes"], part["t"]
            size = np.fromiter(map(len, unit), np.int64, len(unit))
            if (size == size[0]).all():
                dense = np.stack(list(unit))
                near = lambda a, b: np.einsum("ij,ij->i", dense[a], dense[b]) >= threshold  # noqa: B023, E731
                square = lambda s: dense[s] @ dense[s].T >= threshold  # noqa: B023, E731
            else:
                near = lambda a, b: np.array([len(unit[x]) == len(unit[y]) and float(unit[x] @ unit[y]) >= threshold for x, y in zip(a, b, strict=True)], bool)  # noqa: B023, E731
                square = lambda s: np.stack(list(unit[s])) @ np.stack(list(unit[s])).T >= threshold  # noqa: B023, E731
            i, j = buckets.pairs_within(part, near, square)
            same = codes[i] == codes[j]
            first = same.argmax(axis=1) == table[i] if len(i) else np.empty(0, bool)
            yield buckets.linked_rows(part, i[first], j[first], part["n"])

    return full.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")]))


def near_duplicates(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, miss: float = 1e-4, sketch_miss: float = 1e-6, per_bucket: int = 256, block: int = 512, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows without a usable vector (null, zero, null or non-finite components), with vectors of
    another length, or without an id link with nothing of the sort: n_links 0, component_id the own
    id, kept where there is one. Repeated rows are vectors of their own and link with each other.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = vectors.valid(table, ident, vector)
    distinct = materialise(rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")).select("node", "n", "embedding"), "distinct")
    # Two different vectors can share a least id only if ids repeat; a hash of both then tells them apart.
    distinct = distinct.withColumn("key", F.xxhash64("node", "embedding"))
    found = materialise(links(distinct.select(F.col("key").alias("node"), "n", "embedding"), threshold, miss, sketch_miss, per_bucket, block, seed), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("root").alias("src"), F.col("node").alias("dst")))
    known = (
        distinct.join(counts, distinct.key == counts.node, "left").drop(counts.node)
        .join(parts.withColumnRenamed("node", "member"), F.col("key") == F.col("member"), "left")
        .select("key", "node", "n", "embedding", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    )
    known = materialise(known, "known")
    head = known.groupBy("component").agg(F.min("node").alias("component_id"))
    known = known.join(head, "component").select("embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.join(known, "embedding").select("vec_id", "n_links", "component_id")
    out = F.col(ident).cast("long")
    rest = table.where(~vectors.usable(F.col(vector)) | out.isNull()).select(out.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), out.alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
