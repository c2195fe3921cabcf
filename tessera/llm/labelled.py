"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """(text and label of at most per_class learnable rows of each class, learnable rows of each class).

    Learnable: an id, a label of 0 or 1, and crc32 of the id as text not divisible by modulus. An id
    labelled twice takes the larger label, and of a repeated id one row counts: that with a text and
    the least hash of it. The ids with the least hash are taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), modulus) > 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit(3), "doc_id")
    taken = [known.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    # Bounded by 2 * per_class rows of an id and a label.
    few = F.broadcast(taken[0].unionByName(taken[1]).select(F.col("doc_id").alias("labelled_id"), "label"))
    found = docs.join(few, F.col("doc_id") == F.col("labelled_id"))
    kept = [c for c in docs.columns if c.lower() not in ("label", "labelled_id")]
    first = F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), F.struct(*kept).alias("row"))
    one = found.groupBy("labelled_id").agg(F.min(first).alias("first"), F.first("label").alias("label"))
    return one.select(*[F.col("first.row")[c].alias(c) for c in kept], "label"), counts
