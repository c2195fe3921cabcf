"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every document is a sparse vector x: the hashed words, the statistics and the metadata. Its score is
the logistic of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, and the pairs cost only linear time
by sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import ChunkTable
from .common import appended, kept, map_arrow, texts, with_columns
from .labelled import fitting_sample

WORDS = 1 << 15
STATS = ("length", "word_length", "upper", "digit", "symbol", "punctuation", "odd_end", "distinct", "top_share", "same_lines", "line_length", "one_char", "shouted", "stated_length", "length_gap")
_PUNCTUATION = frozenset(".,;:?'\"()-")


def _chunk(chunk: str) -> tuple:
    """bucket, length, upper-case letters, digits, symbols, punctuation, odd ending, one character, all upper case."""
    core = chunk.strip("".join(_PUNCTUATION)).lower() or chunk
    upper, digit = sum(map(str.isupper, chunk)), sum(map(str.isdigit, chunk))
    punctuation = sum(c in _PUNCTUATION for c in chunk)
    symbol = sum(not c.isalnum() for c in chunk) - punctuation
    end = chunk[-1]
    return (zlib.crc32(core.encode("utf-8", "surrogatepass")) % WORDS, len(chunk), upper, digit, symbol, punctuation,
            not end.isalnum() and end not in _PUNCTUATION, len(chunk) == 1, upper > 1 and not any(map(str.islower, chunk)))


class Features:
    """Texts to (indices, values); statistics stand after the words."""

    def __init__(self):
        self.table = ChunkTable(9, _chunk)

    def __call__(self, text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        chunks = text.split()
        stats = np.zeros(len(STATS), "f4")
        stats[0] = np.log1p(len(text))
        stats[13] = np.log1p(max(0, stated or 0))
        stats[14] = abs(stats[13] - stats[0])
        if not chunks:
            return np.arange(WORDS, WORDS + len(STATS)), stats
        rows = self.table.rows(chunks)
        distinct, count = np.unique(rows, return_counts=True)
        values = self.table.values[distinct]
        total = count @ values
        n, size = len(chunks), max(float(total[1]), 1.0)
        lines = [x for x in text.split("\n") if x]
        stats[1:13] = (total[1] / n, total[2] / size, total[3] / size, total[4] / size, total[5] / size, total[6] / n, len(distinct) / n,
                       count.max() / n, 1 - len(set(lines)) / len(lines) if lines else 0, np.log1p(n / max(1, len(lines))), total[7] / n, total[8] / n)
        bucket, at = np.unique(values[:, 0].astype(np.int64), return_inverse=True)
        weight = 1 + np.log(np.bincount(at, count))
        return np.r_[bucket, WORDS : WORDS + len(STATS)], np.r_[weight / np.sqrt(weight @ weight), stats].astype("f4")


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Statistics to zero mean and unit deviation, within bounds."""
        k = len(STATS)
        return np.r_[x[:-k], np.clip((x[-k:] - self.mean) / self.scale, -4, 4) * 0.5]

    def raw(self, i: np.ndarray, x: np.ndarray) -> float:
        x = self.standard(x)
        v = self.v[i]
        s = x @ v
        return float(self.w0 + x @ self.w[i] + 0.5 * (s @ s - (x * x) @ np.einsum("ij,ij->i", v, v)))


def logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def gradient(m: Machine, part: list[tuple[np.ndarray, np.ndarray, int]], weight: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(features, d/dw, d/dv, d/dw0) of the mean weighted logistic loss of rows with standard statistics."""
    i, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
    doc = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
    start = np.r_[0, np.cumsum([len(p[0]) for p in part])[:-1]]
    xv = x[:, None] * m.v[i]
    s = np.add.reduceat(xv, start)
    z = m.w0 + np.add.reduceat(x * m.w[i], start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), start))
    y = np.array([p[2] for p in part])
    g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * np.array([weight[t] for t in y]) / len(part)
    u, back = np.unique(i, return_inverse=True)
    dw, dv = np.bincount(back, g[doc] * x, len(u)), np.zeros((len(u), m.v.shape[1]))
    np.add.at(dv, back, (g[doc] * x)[:, None] * (s[doc] - xv))
    return u, dw, dv, float(g.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], counts: dict[int, int], rank: int = 8, epochs: int = 12, rate: float = 0.08, decay: float = 2e-4, seed: int = 1) -> Machine:
    """Adaptive gradient steps on the logistic loss; the intercept is then moved to the classes' true odds."""
    k, rng = len(STATS), np.random.default_rng(seed)
    size = WORDS + k
    stats = np.array([x[-k:] for _, x, _ in rows]) if rows else np.zeros((1, k))
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)), stats.mean(0), stats.std(0) + 1e-3)
    labels = [y for *_, y in rows]
    if len(set(labels)) < 2:
        m.v[:] = 0
        m.w0 = 4.0 if labels and labels[0] else -4.0 if labels else 0.0
        return m
    data = [(i, m.standard(x), y) for i, x, y in rows]
    weight = {y: len(rows) / (2 * labels.count(y)) for y in (0, 1)}
    gw, gv, g0 = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(data), 32):
            u, dw, dv, d0 = gradient(m, [data[j] for j in order[lo : lo + 32]], weight)
            dw, dv = dw + decay * m.w[u], dv + decay * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            g0 += d0**2
            m.w[u] -= rate * dw / np.sqrt(gw[u])
            m.v[u] -= rate * dv / np.sqrt(gv[u])
            m.w0 -= rate * d0 / np.sqrt(g0)
    m.w0 += float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Machine:
    """Fitted on at most per_class labelled rows of each class; their features, not their texts, reach the driver.

    Those are at most 2 * per_class rows of at most WORDS + len(STATS) numbers each.
    """
    sample, counts = fitting_sample(_inputs(docs), labels, "quality", per_class)

    def make():
        features = Features()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [features(s, n) for s, n in zip(texts(batch), batch.column(1).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([i.astype("i4") for i, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32())), batch.column(2)], names=["i", "x", "label"])

        return fn

    rows = map_arrow(sample.select("text", "n_chars", "label"), make, T.StructType([T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))
    got = rows.toArrow()
    data = [(np.array(i), np.array(x, "f8"), y) for i, x, y in zip(*(c.to_pylist() for c in got.columns), strict=True)]
    data.sort(key=lambda r: (r[2], len(r[0]), r[1].tobytes()))  # the order of arrival is not the cluster's choice
    return train(data, counts)


def _inputs(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", stated.alias("n_chars"))


def score(docs: DataFrame, model: Machine, cut: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= cut).

    Null and empty texts are scored by their metadata and zero statistics; input columns named like
    a result column are replaced; an empty table gives an empty result.
    """
    slim = Machine(model.w0, model.w.astype("f4"), model.v.astype("f4"), model.mean, model.scale)
    shared = docs.sparkSession.sparkContext.broadcast(slim)  # WORDS * (rank + 1) numbers
    at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def make():
        features, machine = kept("features", Features), shared.value

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = texts(batch)
            stated = batch.column(at).to_pylist() if at is not None else [None] * len(rows)
            out = [logistic(machine.raw(*features(s, n))) for s, n in zip(rows, stated, strict=True)]
            return appended(batch, {"score": pa.array(out, pa.float64()), "predicted": pa.array([int(p >= cut) for p in out], pa.int32())})

        return fn

    return map_arrow(docs, make, with_columns(docs.schema, [("score", T.DoubleType()), ("predicted", T.IntegerType())]))
