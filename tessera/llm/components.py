"""Connected components by randomised contraction, all joins and partial aggregations.

Each round every vertex takes the neighbour (or itself) of least hash under that round's salt as
its representative; edges are renamed to representatives, loops and repetitions go. The number of
vertices with edges falls by a constant factor in expectation whatever the shape, chains and stars
included. The rounds' maps are then composed. Everything between rounds is written to the shared
folder, so lost executors cost a reread, and nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, seed: int = 97) -> DataFrame:
    """edges(src, dst) of longs -> (node, component) of every node that has an edge; component is its least node."""
    edges = materialise(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    labels, turn = None, 0
    while turn == 0 or not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.lit(seed + turn), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.select("src", ranked("dst").alias("r")).groupBy("src").agg(F.min("r").alias("r"))
        step = materialise(least.select(F.col("src").alias("node"), F.least("r", ranked("src"))["v"].alias("rep")), "map")
        if labels is None:
            labels = step
        else:
            after = step.select(F.col("node").alias("rep"), F.col("rep").alias("next"))
            labels = labels.join(after, "rep", "left").select("node", F.coalesce("next", "rep").alias("rep"))
        moved = (
            edges.join(step.select(F.col("node").alias("src"), F.col("rep").alias("a")), "src")
            .join(step.select(F.col("node").alias("dst"), F.col("rep").alias("b")), "dst")
            .where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        )
        edges, turn = materialise(moved, "edges"), turn + 1
    labels = materialise(labels, "labels")
    names = labels.groupBy("rep").agg(F.min("node").alias("component"))
    return labels.join(names, "rep").select("node", "component")
