"""Exact verification inside hash buckets of any size, without listing their pairs.

A bucket with more rows than `block` is cut by a hash into parts; every two parts meet in a group
of their own, so the work of a hot bucket spreads over tasks and no task holds more than two parts.
A group's links are found with array operations and leave it as one row for each linked vertex: how
much it is linked to there, and the least vertex it reaches there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

def dealt(rows: DataFrame, light: DataFrame, ident: str, block: int) -> DataFrame:
    """rows(bucket, ident, ...) -> the same with group, side: one copy for each group a row belongs to.

    light has the same (bucket, ident) and serves for counting. The hot buckets are written first, so
    that Spark knows their size when it chooses the join: few are broadcast, and rows are not
    exchanged for them. A bucket of n rows is copied n / block times: the work on distinct rows that
    all share one bucket grows with their square, in parallel.
    """
    hot = light.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = materialise(hot.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("parts")), "hot")
    rows = rows.join(hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("side", F.pmod(F.xxhash64(F.lit(7), ident), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.when(F.col("parts") == 1, F.xxhash64("bucket")).otherwise(
        F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")))
    within = F.col("side") == F.col("other")
    return rows.withColumn("group", group).withColumn("mixed", ~within).drop("parts", "other")


def whole_groups(batches, columns: Callable[[pa.RecordBatch], dict[str, np.ndarray]]):
    """Arrays of consecutive rows that hold whole groups; the input is sorted by group."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        if held is not None:
            now = {k: np.concatenate([held[k], now[k]]) for k in now}
        last = np.searchsorted(now["group"], now["group"][-1], side="left")
        if last:
            yield {k: v[:last] for k, v in now.items()}
        held = {k: v[last:] for k, v in now.items()}
    if held is not None:
        yield held


def pairs_within(rows: dict[str, np.ndarray], near: Callable[[np.ndarray, np.ndarray], np.ndarray], matrix: Callable[[slice], np.ndarray], large: int = 48):
    """(i, j) index arrays of linked rows of a group; in a mixed group only rows of different sides."""
    group, side, mixed = rows["group"], rows["side"], rows["mixed"]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(group)) - 1  # rows after this one in its group
    small = np.repeat(sizes < large, sizes)
    out_i, out_j = [], []
    for d in range(1, min(int(sizes.max()), large)):
        i = np.flatnonzero(small & (left >= d))
        j = i + d
        ok = ~mixed[i] | (side[i] != side[j])
        i, j = i[ok], j[ok]
        ok = near(i, j)
        out_i.append(i[ok])
        out_j.append(j[ok])
    for s, n in zip(starts[sizes >= large], sizes[sizes >= large], strict=True):
        hit = np.triu(matrix(slice(s, s + n)), 1)
        if mixed[s]:
            hit &= side[s : s + n, None] != side[None, s : s + n]
        i, j = np.nonzero(hit)
        out_i.append(i + s)
        out_j.append(j + s)
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_i]).astype(np.int64), np.concatenate([empty, *out_j]).astype(np.int64)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n rows the least row that the links i-j reach."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def linked_rows(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, weight: np.ndarray | None = None) -> pa.RecordBatch:
    """(node, links, root) of every row with a link."""
    n, ident = len(rows["group"]), rows["id"]
    order = np.lexsort((ident, rows["group"]))  # a root is then the least id of its links
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = roots(n, rank[i], rank[j])
    w = np.ones(n, np.int64) if weight is None else weight
    links = np.zeros(n, np.int64)
    np.add.at(links, i, w[j])
    np.add.at(links, j, w[i])
    has = np.zeros(n, bool)
    has[i] = has[j] = True
    at = np.flatnonzero(has)
    return pa.RecordBatch.from_arrays([pa.array(ident[at]), pa.array(links[at]), pa.array(ident[order[label[rank[at]]]])], names=["node", "links", "root"])
