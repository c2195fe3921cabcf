"""Approximate nearest neighbours along shifted Hilbert curves.

Every curve projects the unit vectors on a few random directions, spreads the projections evenly,
shifts them at random and orders the vectors by their Hilbert position. Spark range-partitions all
curves at once, and ranges of a small table are cut into blocks; a query looks through its own block
and those next to it along each curve, at least `share` of the curve and `rows_more` vectors to each
side. The blocks' and curves' results merge and the best by cosine in double precision stay. A
worker holds one block and lets its queries pass by, so memory does not grow with the number of
queries. Equal vectors are one entry of the index that carries its smallest ids, as many as a result
can hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors
from .common import materialise
from .hilbert import positions


def _keys(curves: int, dims: int, bits: int, seed: int):
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(matrix: np.ndarray) -> np.ndarray:
        n = matrix.shape[1]
        if n not in made:
            rng = np.random.default_rng([seed, n])
            made[n] = rng.standard_normal((n, curves * dims)), rng.random(curves * dims)
        directions, shift = made[n]
        level = 1 / (1 + np.exp(-1.702 * (vectors.unit(matrix) @ directions)))  # close to the normal distribution
        cells = np.clip(((level + shift) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
        return np.stack([positions(cells[:, c * dims : (c + 1) * dims], bits) for c in range(curves)], axis=1)

    return keys


def _best(asking: np.ndarray, others: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asking, row of others, score) of the `most` largest scores; ties go to the smaller low.

    The last bits of a matrix product depend on its shape, so what comes near the border is scored
    again pair by pair: equal pairs then tie in every block.
    """
    rough = asking @ others.T
    keep = min(most, len(others))
    floor = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1] - 1e-12
    row, column = np.nonzero(rough >= floor[:, None])
    score = np.concatenate([np.einsum("ij,ij->i", asking[row[i : i + 65536]], others[column[i : i + 65536]]) for i in range(0, len(row), 65536)])
    order = np.lexsort((low[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < keep
    return row[kept], column[kept], score[kept]


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, ident: str = "vec_id", vector: str = "embedding", curves: int = 16, dims: int = 8, bits: int = 7, share: float = 0.03, rows_more: int = 128, range_rows: int = 8192, blocks: int = 128, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest; queries has the ident of rows of the table.

    Unusable vectors (null, zero, null or non-finite components) and rows without an id take no
    part, nor do vectors of another length than the query's. Rows repeated in id and vector count
    once. Ties go to the smaller id. An empty table or no queries give an empty result. A curve has
    a range for every range_rows vectors and at least `blocks` blocks.
    """
    rows = vectors.valid(table, ident, vector)
    low = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    index = rows.withColumn("low", low).where(F.col("low") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asked = rows.join(queries.select(F.col(ident).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    index = index.join(asked.select("embedding", F.lit(True).alias("asked")).distinct(), "embedding", "left")
    index = index.select(F.xxhash64("embedding", F.col("ids")[0]).alias("node"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "embedding")
    kind = "<f4" if index.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"

    def keyed(batches):
        keys = _keys(curves, dims, bits, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.zeros((batch.num_rows, curves), np.int64)
            for at, matrix in vectors.by_length(batch.column(3)):
                out[at] = keys(matrix)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, curves, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors.pack(batch.column(3), kind), lists], names=schema.names)

    schema = T.StructType([*index.schema.fields, T.StructField("packed", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    index = index.mapInArrow(keyed, schema).withColumn("embedding", F.when(F.col("asked"), F.col("embedding")))
    index = materialise(index, "index")
    n = index.count()
    ranges = max(12, -(-n // range_rows))
    parts = -(-blocks // ranges)
    # Keys alone are ordered; a vector moves once a curve, to the block that its keys have found.
    spread = index.select("node", F.posexplode("keys").alias("curve", "key"))
    spread = spread.repartitionByRange(ranges * curves, "curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    place = {"range": F.spark_partition_id().cast("long"), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    spread = materialise(spread.withColumns(place).select("curve", "range", "at", "node"), "ranges")
    width = ((spread.agg(F.max("range")).first()[0] or 0) + 1) * parts
    if parts > 1:  # then there are fewer than blocks ranges a curve, which bounds what is broadcast
        sizes = spread.groupBy("range").agg((F.max("at") + 1).alias("size"))
        spread = spread.join(F.broadcast(sizes), "range").withColumn("block", F.col("range") * parts + F.floor(F.col("at") * parts / F.col("size")))
    else:
        spread = spread.withColumn("block", F.col("range"))
    reach = max(1, math.ceil((share + rows_more / max(1, n)) * width / curves))
    whole = spread.select("curve", "block", "node").join(index.select("node", F.col("ids")[0].alias("low"), "asked", "packed"), "node")
    held = F.array(F.struct(F.col("block"), F.lit(0).alias("role")))
    near = F.transform(F.sequence(F.col("block") - reach, F.col("block") + reach), lambda b: F.struct(b.alias("block"), F.lit(1).alias("role")))
    found = whole.select("curve", F.explode(F.when(F.col("asked"), F.concat(held, near)).otherwise(held)).alias("to"), "node", "low", "packed")
    found = found.select("curve", "to.block", "to.role", "node", "low", "packed")
    found = found.repartition("curve", "block").sortWithinPartitions("curve", "block", "role")

    def run(batches):
        at, pool, out = None, {}, []

        def flush():
            names = ["node", "other", "low", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
            out.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            curve, block, role, node, low = (batch.column(i).to_numpy() for i in range(5))
            edge = np.flatnonzero(np.r_[True, (curve[1:] != curve[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1])])
            for a, b in zip(edge, np.r_[edge[1:], len(node)], strict=True):
                if (curve[a], block[a]) != at:
                    at, pool = (curve[a], block[a]), {}
                for row, matrix in vectors.by_packed(batch.column(5).slice(a, b - a), kind):
                    unit, mine = vectors.unit(matrix), pool.setdefault(matrix.shape[1], [])
                    if role[a] == 0:
                        mine.append((unit, node[a:b][row], low[a:b][row]))
                    elif mine:
                        if len(mine) > 1:
                            mine[:] = [tuple(map(np.concatenate, zip(*mine, strict=True)))]
                        others, names, lows = mine[0]
                        for lo in range(0, len(unit), 256):
                            q, c, score = _best(unit[lo : lo + 256], others, lows, k + 1)
                            out.append((node[a:b][row][lo : lo + 256][q], names[c], lows[c], score))
                        if len(out) > 256:
                            yield from flush()
        if out:
            yield from flush()

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("other", T.LongType()), T.StructField("low", T.LongType()), T.StructField("score", T.DoubleType())])
    merged = found.mapInArrow(run, schema).groupBy("node", "other", "low").agg(F.max("score").alias("score"))
    # The k + 1 best entries hold the k best rows besides the query's own, ties included.
    first = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "low"))
    merged = merged.withColumn("first", first).where(F.col("first") <= k + 1)
    own = index.where("asked").select("node", "embedding").join(asked.distinct(), "embedding").select("node", F.col("vec_id").alias("query_id"))
    ids = index.select(F.col("node").alias("other"), "ids")
    listed = own.join(merged, "node").join(ids, "other").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
