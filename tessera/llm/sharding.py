"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

Rows are spread over buckets by a hash. How many rows of each bucket go to each shard is drawn
exactly as a uniform permutation would deal them: a matrix with the bucket sizes and the shard sizes
as margins, each entry hypergeometric given those before it. Each bucket orders its rows at random
and cuts that order by its row of the matrix; each shard orders what it gets at random again. All of
it is DataFrame expressions; only ids, sizes and checksums are exchanged, texts never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A weight this many standard deviations (and ten times as many outcomes) from its mode no longer changes a double's sum.
_REACH = 12


def _uniform(*parts: Column) -> Column:
    """A double in (0, 1) from a hash of parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items, taken without return from `total`, are among the `marked`: inversion of u.

    Weights relative to the mode follow from the ratio of neighbouring probabilities; a first pass
    up and down adds them, a second finds where their running sum passes u times the sum.
    """
    none = F.lit(None).cast("double")

    def more(x: Column, **fields: Column) -> Column:
        return F.struct(*[x[f].alias(f) for f in ("n", "k", "d", "u", "low", "high", "mode", "reach", "goal") if f not in fields], *[v.alias(f) for f, v in fields.items()])

    def bounds(x: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), x["d"] - (x["n"] - x["k"])), F.least(x["k"], x["d"])
        share = x["k"] / F.greatest(x["n"], F.lit(1.0))
        reach = F.sqrt(F.greatest(F.lit(0.0), x["d"] * share * (1 - share))) * _REACH + 10 * _REACH
        mode = F.floor((x["d"] + 1) * (x["k"] + 1) / (x["n"] + 2)).cast("double")
        return more(x, low=low, high=high, mode=F.least(high, F.greatest(low, mode)), reach=reach)

    def walk(x: Column, sign: int, start: Column, find: bool) -> Column:
        """struct(w: last weight, s: running sum, at: first outcome whose running sum passes the goal)."""
        n, k, d = x["n"], x["k"], x["d"]
        room = F.least(x["reach"], x["high"] - x["mode"] if sign > 0 else x["mode"] - x["low"]).cast("int")

        def step(acc: Column, i: Column) -> Column:
            v = x["mode"] + sign * (i - 1)
            up, down = (k - v) * (d - v) / ((v + 1) * (n - k - d + v + 1)), v * (n - k - d + v) / ((k - v + 1) * (d - v + 1))
            w = acc["w"] * (up if sign > 0 else down)
            at = F.when(acc["at"].isNull() & (acc["s"] + w > x["goal"]), v + sign).otherwise(acc["at"]) if find else none
            return F.struct(w.alias("w"), (acc["s"] + w).alias("s"), at.alias("at"))

        steps = F.when(room >= 1, F.sequence(F.lit(1), room)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), start.alias("s"), none.alias("at")), step)

    def found(x: Column) -> Column:
        return _let(walk(x, 1, F.lit(1.0), True), lambda above: F.when(x["goal"] < 1, x["mode"]).otherwise(
            F.coalesce(above["at"], walk(x, -1, above["s"], True)["at"], x["mode"])).cast("bigint"))

    given = F.struct(total.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("d"), u.alias("u"),
                     *[F.lit(0.0).alias(f) for f in ("low", "high", "mode", "reach", "goal")])
    return _let(given, lambda x: _let(bounds(x), lambda y: _let(
        more(y, goal=y["u"] * (walk(y, 1, F.lit(1.0), False)["s"] + walk(y, -1, F.lit(0.0), False)["s"])), found)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def deal(sizes: Column, room: Column, salt: Column) -> Column:
    """Rows of the communication matrix, one array a bucket: bucket sizes and shard room are its margins."""

    def bucket(acc: Column, size_at: Column) -> Column:
        size, at = size_at["size"], size_at["at"]

        def shard(inner: Column, j: Column) -> Column:
            marked = F.element_at(acc["room"], j)
            got = hypergeometric(inner["items"], marked, inner["left"], _uniform(salt, at, j))
            return _let(got, lambda g: F.struct(
                (inner["items"] - marked).alias("items"),
                (inner["left"] - g).alias("left"),
                F.concat(inner["row"], F.array(g)).alias("row"),
            ))

        start = F.struct(
            F.aggregate(acc["room"], F.lit(0).cast("bigint"), lambda a, b: a + b).alias("items"),
            size.cast("bigint").alias("left"),
            F.array().cast("array<bigint>").alias("row"),
        )
        row = F.aggregate(F.sequence(F.lit(1), F.size(acc["room"])), start, shard, lambda x: x["row"])
        return _let(row, lambda r: F.struct(
            F.zip_with(acc["room"], r, lambda a, b: a - b).alias("room"),
            F.concat(acc["rows"], F.array(r)).alias("rows"),
        ))

    first = F.struct(room.alias("room"), F.array().cast("array<array<bigint>>").alias("rows"))
    return F.aggregate(F.transform(sizes, lambda s, i: F.struct(s.alias("size"), i.alias("at"))), first, bucket, lambda x: x["rows"])


def communication_matrix(sizes: DataFrame, buckets: int, n_rows: int, shards: int, seed: int, width: int) -> DataFrame:
    """sizes(bucket, n) -> (bucket, cuts): running sums over shards of the rows that each bucket sends.

    Drawn down a tree: the buckets stand in groups of `width`, these in groups of `width` again, and
    so on up to one; each group deals its share of every shard to its members. No row of any level
    holds more than `width` members, whatever the number of buckets.
    """
    even = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    levels, nodes = [sizes.select(F.col("bucket").alias("node"), "n")], buckets
    members = F.sort_array(F.collect_list(F.struct("node", "n"))).alias("members")
    groups = []
    while nodes > 1 or not groups:
        up = F.floor(F.col("node") / width).alias("group")
        groups.append(materialise(levels[-1].groupBy(up).agg(F.sum("n").alias("n"), members), "shard-groups"))
        levels.append(groups[-1].select(F.col("group").alias("node"), "n"))
        nodes = -(-nodes // width)
    room = F.array(*[F.lit(x).cast("bigint") for x in even])
    dealt = groups[-1].select("group", room.alias("room"))
    for depth in range(len(groups) - 1, -1, -1):
        rows = groups[depth].join(dealt, "group").select(
            "members", deal(F.col("members.n"), F.col("room"), F.xxhash64(F.lit(seed), F.lit(depth), F.col("group"))).alias("rows"))
        pair = rows.select(F.explode(F.arrays_zip(F.col("members.node").alias("node"), F.col("rows").alias("room"))).alias("z"))
        dealt = pair.select(F.col("z.node").alias("group"), "z.room")
    running = F.aggregate("room", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    return dealt.select(F.col("group").alias("bucket"), running.alias("cuts"))


def uniform_shards(docs: DataFrame, shards: int = 8, seed: int = 20_417, rows_per_bucket: int = 50_000, group_width: int = 256) -> DataFrame:
    """Every row's shard and slot: a uniform shuffle with shard sizes at most one apart.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. A null text has size 1 and the
    checksum of no bytes; a null doc_id is dealt like any other. Every row gets a number that is
    written with it, and the shuffle goes by that number: rows equal in id and text are spread over
    buckets, shards and slots like different ones. An empty table gives an empty result. Other input
    columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(slim.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    n = rows.count()
    buckets = max(32, -(-n // rows_per_bucket))
    key = lambda k: F.xxhash64(F.lit(seed + k), "row")
    rows = rows.withColumn("bucket", F.pmod(key(1), F.lit(buckets))).withColumn("k2", key(2)).withColumn("k3", key(3))
    matrix = communication_matrix(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), buckets, n, shards, seed, group_width)
    local = Window.partitionBy("bucket").orderBy("k2", "row")
    sent = (
        rows.withColumn("i", F.row_number().over(local)).join(matrix, "bucket")
        .withColumn("shard", F.aggregate("cuts", F.lit(0), lambda acc, c: acc + (c < F.col("i")).cast("int")))
        .withColumn("part", F.pmod(F.col("k3"), F.lit(buckets)))
        .select("doc_id", "size", "text_crc32", "shard", "part", "k3", "row")
    )
    sent = materialise(sent, "shard-sent")
    within = Window.partitionBy("shard", "part").orderBy("k3", "row")
    starts = sent.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "start", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n"))
    return (
        sent.withColumn("j", F.row_number().over(within)).join(starts.drop("n"), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                (F.col("start") + F.col("j") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
