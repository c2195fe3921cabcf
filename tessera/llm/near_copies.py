"""Near copies by word shingles: covering SimHash for candidates, the exact overlap for links.

A fingerprint of 64 bits can't carry a similarity of 0.8: at that Jaccard it differs in about ten
places, and masks that cover ten bits leave keys that half the table shares. So fingerprints are
longer, as long as the table needs, and cut into parts; every part gets the covering masks of RADIUS.
A pair that differs in at most RADIUS bits of some part agrees under one of that part's masks, so no
pair within parts * (RADIUS + 1) - 1 bits lacks a common key, and of pairs at the threshold, whose
signs differ in 15 of 100 places, MISS. Keys grow with the logarithm of the rows, and with them the parts.

Only a sketch of the fingerprint travels to the buckets of keys. What it leaves possible there makes
groups of candidates, and every candidate is settled on the shingles themselves, without all pairs of a
group. A text of whose shingles no other has enough is like none. The rest of a group is compared with
its hub, the text with the fewest shingles of its own, which joins most of what can be joined. What two
texts of different components share is at most what both share with the hub, and what both hold beside
it and others hold too; only pairs that this leaves possible are compared, in groups of their own.
Groups of equal members are looked at once. Documents of equal shingles are one vertex.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buckets
from .common import appended, let_go, map_arrow, materialise, texts, with_columns
from .components import connected_components
from .embed_dedup import most_apart
from .simhash import masks, shingle_hashes

WIDTH, RADIUS = 5, 1
#: The least Jaccard similarity of a link, as a fraction.
LEAST = (4, 5)
#: The cosine of two sets at that similarity; least for sets of one size.
COSINE = 2 * LEAST[0] / (LEAST[0] + LEAST[1])
#: The probability that two sets at the threshold have no key in common, and that their sketches differ too much.
MISS, SKETCH_MISS = 5e-5, 1e-5
#: Vertices that share a key by chance, at most, and words of a sketch.
PER_BUCKET, SKETCH = 900, 3
#: Least hashes by which texts of a family within a family meet.
LEAST_HASHES = 2
#: Votes of a shingle on a sign. With one, sets of four and five shingles tie too often.
VOTES = 2
_TIMES = np.random.default_rng(20).integers(0, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def plan(rows: int) -> tuple[int, int]:
    """(parts, bits of a part) of the fingerprints of so many rows.

    The three masks of radius 1 each take two of a part's three classes of bits, so sets meet where two classes agree.
    """
    size = max(5, math.ceil(math.log2(max(1, rows) / PER_BUCKET) / 2))
    same = (1 - math.acos(COSINE) / math.pi) ** size
    parts = math.ceil(math.log(MISS) / math.log1p(2 * same**3 - 3 * same**2))
    return max(parts, -(-64 * SKETCH // (3 * size))), 3 * size


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's word shingles, ascending."""
    return np.unique(shingle_hashes(text, width).astype(np.uint64))


def fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of shingles as 64 * words bits: 1 where over half the votes are."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(shingles), 1024):
        votes = shingles[at : at + 1024, None] * _TIMES[: VOTES * words]
        for by in _MIX:
            votes ^= votes >> np.uint64(33)
            votes *= by
        votes ^= votes >> np.uint64(33)
        votes = np.unpackbits(votes.reshape(-1, words).view(np.uint8), axis=1)
        for k in range(0, len(votes), 255):
            ones += votes[k : k + 255].sum(axis=0, dtype=np.uint8)
    return (ones * 2 > VOTES * len(shingles)).astype(np.uint8)


def similar(shared, sizes):
    """Whether so many shared shingles, of so many in both sets together, reach the least similarity."""
    return shared * (LEAST[0] + LEAST[1]) >= LEAST[0] * sizes


def shared_counts(sets: list[np.ndarray], step: int = 4096, at_once: int = 1 << 20) -> np.ndarray:
    """How many shingles every two sets share; of large sets one range of the hashes after the other, about at_once together."""
    out = np.zeros((len(sets), len(sets)), np.int64)
    parts = max(1, -(-sum(map(len, sets)) // at_once))
    edges = np.array([k * ((1 << 64) // parts) for k in range(1, parts)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(s, edges), len(s)] for s in sets]
    for k in range(parts):
        part = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        _, number, times = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
        common = times > 1
        column = (np.cumsum(common) - 1)[number]
        owner, column = owner[common[number]], column[common[number]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, int(common.sum()), step):
            a, b = np.searchsorted(column, [lo, lo + step])
            held = np.zeros((len(sets), step), "f4")
            held[owner[a:b], column[a:b] - lo] = 1
            out += np.rint(held @ held.T).astype(np.int64)
    return out


def with_prints(docs: DataFrame, parts: int, bits: int) -> DataFrame:
    """docs with `fp`, a digest of the set of shingles, its `size`, `sketch`, and `parts` of the fingerprint; none without shingles."""
    words = -(-parts * bits // 64)
    power = 1 << np.arange(bits, dtype=np.int64)

    def make():
        let_go()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps, sizes, sketches, prints = [], [], [], []
            for s in texts(batch):
                shingles = shingle_set(s)
                fps.append(xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63))
                sizes.append(len(shingles))
                ones = fingerprint(shingles, words)
                sketches.append(np.packbits(ones[: 64 * SKETCH]).view(np.int64))
                prints.append(ones[: parts * bits].reshape(parts, bits) @ power if len(shingles) else [])
            longs = pa.list_(pa.int64())
            return appended(batch, {"fp": pa.array(fps, pa.int64()), "size": pa.array(sizes, pa.int64()), "sketch": pa.array(sketches, longs), "parts": pa.array(prints, longs)})

        return fn

    longs = T.ArrayType(T.LongType())
    return map_arrow(docs, make, with_columns(docs.schema, [("fp", T.LongType()), ("size", T.LongType()), ("sketch", longs), ("parts", longs)]))


def candidates(prints: DataFrame, bits: int, block: int = 1024) -> DataFrame:
    """prints(fp, sketch, parts), distinct -> (bucket, fp), the groups of candidates; bucket is a group's least fp, and every fp is in one at most.

    Any two that share a key and whose sketches are near are in one group, directly or by way of others.
    The holders of a key are compared in parts of `block`, each in one part. Where a key has several parts,
    its largest component so far, mostly one family, is not compared within itself again: its members meet
    the other holders of the key, and these one another.
    """
    words = [F.col("sketch")[k].alias(f"w{k}") for k in range(SKETCH)]
    at = prints.select("fp", *words, F.posexplode("parts").alias("at", "part"))
    keys = [F.xxhash64("at", F.lit(t), F.col("part").bitwiseAND(F.lit(m & ((1 << bits) - 1)))) for t, m in enumerate(masks(RADIUS))]
    rows = at.select("fp", *[f"w{k}" for k in range(SKETCH)], F.explode(F.array(*keys)).alias("bucket"))
    hot = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = materialise(hot.select("bucket", F.ceil(F.col("n") / block).alias("parts")), "hot")
    spread = F.xxhash64("bucket", "fp")
    once = rows.join(hot, "bucket", "left").withColumn("group", F.xxhash64("bucket", F.pmod(spread, F.coalesce("parts", F.lit(1)))))
    label = connected_components(_near(once))
    if not hot.isEmpty():
        again = rows.join(hot.select("bucket"), "bucket").join(label.withColumnRenamed("node", "fp"), "fp", "left")
        again = materialise(again.withColumn("of", F.coalesce("component", "fp")).drop("component"), "again")
        most = again.groupBy("bucket", "of").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
        most = most.agg(F.max(F.struct("n", "of")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
        most = most.select("bucket", F.col("most.of").alias("large"), F.ceil((F.col("n") - F.col("most.n")) / block).alias("few"), F.ceil(F.col("most.n") / block).alias("many"))
        again = again.join(most, "bucket").withColumn("inside", F.col("of") == F.col("large"))
        again = again.withColumn("side", F.when(F.col("inside"), F.col("few") + F.pmod(spread, F.col("many"))).otherwise(F.pmod(spread, F.col("few"))))
        last = F.when(F.col("inside"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
        again = again.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        again = again.withColumn("group", F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))).withColumn("mixed", F.col("side") != F.col("other"))
        found = materialise(_near(again, True), "near")
        if not found.isEmpty():
            label = connected_components(label.select(F.col("component").alias("src"), F.col("node").alias("dst")).unionByName(found))
    return label.select(F.col("component").alias("bucket"), F.col("node").alias("fp"))


def _near(rows: DataFrame, again: bool = False) -> DataFrame:
    """rows(group, fp, w0, ...) -> edges (src, dst) whose components are those of the pairs of a group with near sketches.

    again: rows also has side, mixed (as buckets.dealt gives them) and `of`, and two of the same `of` are no pair.
    """
    apart = most_apart(64 * SKETCH, COSINE, SKETCH_MISS)
    rows = rows.select("group", "fp", *[f"w{k}" for k in range(SKETCH)], *(("side", "mixed", "of") if again else ())).repartition("group").sortWithinPartitions("group")

    def run(batches):
        def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
            sketch = np.stack([b.column(2 + k).to_numpy().view(np.uint64) for k in range(SKETCH)], axis=1)
            out = {"group": b.column(0).to_numpy(), "id": b.column(1).to_numpy(), "sketch": sketch}
            if again:
                side, mixed, of = (b.column(2 + SKETCH + k).to_numpy(zero_copy_only=False) for k in range(3))
                return out | {"side": side, "mixed": mixed, "of": of}
            return out | {"side": np.zeros(len(sketch), np.int8), "mixed": np.zeros(len(sketch), bool)}

        for part in buckets.whole_groups(batches, columns):
            sketch, of = part["sketch"], part.get("of")

            def near(a, b):
                hit = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= apart  # noqa: B023
                return hit if of is None else hit & (of[a] != of[b])  # noqa: B023

            def square(s):
                hit = sum(np.bitwise_count(w[s, None] ^ w[None, s]) for w in sketch.T) <= apart  # noqa: B023
                return hit if of is None else hit & (of[s, None] != of[None, s])  # noqa: B023

            yield buckets.linked_rows(part, *buckets.pairs_within(part, near, square))

    found = rows.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")]))
    return found.select(F.col("root").alias("src"), F.col("node").alias("dst"))


def alone(said: DataFrame) -> DataFrame:
    """said(fp, text) -> (fp, alone): how many of a text's shingles no other text has; none is not listed."""

    def run(batches):
        for batch in batches:
            for fp, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                shingles = shingle_set(text)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), fp, np.int64)), pa.array(shingles.view(np.int64))], names=["fp", "shingle"])

    each = said.select("fp", "text").mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("fp", "shingle")]))
    owner = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp")).where("n = 1")
    return owner.groupBy("fp").agg(F.count(F.lit(1)).alias("alone"))


def overlaps(pairs: DataFrame, said: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """pairs(src, dst) -> the same with `shared`, how many shingles both texts have, and `sizes`, how many each has, added up.

    A worker keeps the sets of about at_once shingles; few texts are the src of most pairs.
    """
    both = pairs.join(said.select(F.col("fp").alias("src"), F.col("text").alias("a")), "src")
    both = both.join(said.select(F.col("fp").alias("dst"), F.col("text").alias("b")), "dst").select("src", "dst", "a", "b")

    def run(batches):
        held, total = {}, 0

        def shingles(fp: int, text: pa.Scalar) -> np.ndarray:
            nonlocal total
            if fp not in held:
                if total > at_once:
                    held.clear()
                    total = 0
                held[fp] = shingle_set(text.as_py())
                total += len(held[fp])
            return held[fp]

        for batch in batches:
            shared, sizes = [], []
            for i, (src, dst) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                one, two = shingles(src, batch.column(2)[i]), shingles(dst, batch.column(3)[i])
                shared.append(len(np.intersect1d(one, two, assume_unique=True)))
                sizes.append(len(one) + len(two))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], names=["src", "dst", "shared", "sizes"])

    return both.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("src", "dst", "shared", "sizes")]))


def possible(rows: DataFrame, block: int = 512) -> DataFrame:
    """rows(bucket, fp, component, size, shared, beside) -> those that may be similar to one of another component of their bucket.

    shared counts a text's shingles that its bucket's hub has, beside the others that count. Texts of the same
    counts stand or fall together, so counts are compared and not texts; large ones are rounded to 8 bits,
    sizes down and the others up, so that there are not as many as texts. No pair is lost by that.
    """
    unit = F.expr("cast(pow(2, greatest(0, floor(log2(size)) - 7)) as long)")
    up = lambda c: F.ceil(F.col(c) / unit) * unit
    names = ("size", "shared", "beside", "lo", "hi")
    counts = [(F.col("size") - F.col("size") % unit).alias("size"), up("shared").alias("shared"), up("beside").alias("beside")]
    rows = rows.withColumn("like", F.xxhash64("bucket", *counts))
    kinds = rows.select("bucket", "like", "component", *counts).groupBy("bucket", "like").agg(
        *[F.first(c).alias(c) for c in names[:3]], F.min("component").alias("lo"), F.max("component").alias("hi"))
    kinds = materialise(kinds, "kinds")
    kinds = buckets.dealt(kinds, kinds.select("bucket", "like"), "like", block)
    kinds = kinds.select("group", "side", "mixed", "like", *names).repartition("group").sortWithinPartitions("group")

    def run(batches):
        def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = {"group": b.column(0).to_numpy(), "side": b.column(1).to_numpy(), "mixed": b.column(2).to_numpy(zero_copy_only=False), "id": b.column(3).to_numpy()}
            return out | {name: b.column(4 + k).to_numpy() for k, name in enumerate(names)}

        for part in buckets.whole_groups(batches, columns):
            size, shared, beside, lo, hi = (part[name] for name in names)

            def may(a, b):
                most = np.minimum(shared[a], shared[b]) + np.minimum(beside[a], beside[b])  # noqa: B023
                return similar(most, size[a] + size[b]) & (np.minimum(lo[a], lo[b]) != np.maximum(hi[a], hi[b]))  # noqa: B023

            i, j = buckets.pairs_within(part, may, lambda s: may(np.r_[s][:, None], np.r_[s][None, :]))  # noqa: B023
            own = np.arange(len(size))
            on = np.unique(np.r_[i, j, np.flatnonzero(may(own, own))])
            yield pa.RecordBatch.from_arrays([pa.array(part["id"][on])], names=["like"])

    on = kinds.mapInArrow(run, T.StructType([T.StructField("like", T.LongType())]))
    return rows.join(materialise(on, "on"), "like", "left_semi").drop("like")


def beside(rows: DataFrame, said: DataFrame) -> DataFrame:
    """rows(bucket, hub, fp) -> (bucket, fp, shingle): what a text has beside its hub and another of its bucket has too."""
    both = rows.select("bucket", "hub", "fp").join(said.select(F.col("fp").alias("hub"), F.col("text").alias("a")), "hub")
    both = both.join(said.select("fp", F.col("text").alias("b")), "fp").select("bucket", "fp", "hub", "a", "b")

    def run(batches):
        of, hub = None, np.empty(0, np.uint64)
        for batch in batches:
            for bucket, fp, src, one, two in zip(*(batch.column(k) for k in range(5)), strict=True):
                if of != src.as_py():
                    of, hub = src.as_py(), shingle_set(one.as_py())
                own = np.setdiff1d(shingle_set(two.as_py()), hub, assume_unique=True).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket.as_py(), np.int64)), pa.array(np.full(len(own), fp.as_py(), np.int64)), pa.array(own)], names=["bucket", "fp", "shingle"])

    each = materialise(both.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("bucket", "fp", "shingle")])), "each")
    common = each.groupBy("bucket", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "shingle")
    return each.join(common, ["bucket", "shingle"])


def _group_links(members: DataFrame, said: DataFrame, block: int) -> DataFrame:
    """Edges whose components, in members(bucket, fp), are those of all similar pairs."""
    rows = buckets.dealt(members, members, "fp", block).select("group", "side", "mixed", "fp").join(said, "fp")
    rows = rows.select("group", "side", "mixed", "fp", "text").repartition("group").sortWithinPartitions("group")

    def links(held: list[tuple]) -> pa.RecordBatch:
        n = len(held)
        sets = [shingle_set(r[4]) for r in held]
        sizes = np.array([len(s) for s in sets])
        hit = np.triu(similar(shared_counts(sets), sizes[:, None] + sizes[None, :]), 1)
        side = np.array([r[1] for r in held])
        if held[0][2]:
            hit &= side[:, None] != side[None, :]
        part = {"group": np.zeros(n, np.int64), "id": np.array([r[3] for r in held], np.int64)}
        return buckets.linked_rows(part, *np.nonzero(hit))

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)

    found = rows.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("node", "links", "root")]))
    return found.select(F.col("root").alias("src"), F.col("node").alias("dst"))


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows(fp, ...) with `component`, by the edges found."""
    label = connected_components(found).withColumnRenamed("node", "fp")
    return rows.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def links(members: DataFrame, sizes: DataFrame, said: DataFrame, block: int) -> DataFrame:
    """Edges whose components are those of all similar pairs of a group in members(bucket, fp), each fp in one; sizes(fp, size), said(fp, text)."""
    held = said.select("fp").join(sizes, "fp").join(alone(said), "fp", "left").withColumn("held", F.col("size") - F.coalesce("alone", F.lit(0)))
    held = materialise(held.where(F.col("held") * LEAST[1] >= F.col("size") * LEAST[0]).select("fp", "size", "held"), "held")
    rows = members.join(held, "fp")
    best = F.max(F.struct((F.col("held") / F.col("size")).alias("share"), "fp")).alias("best")
    hubs = rows.groupBy("bucket").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.col("best.fp").alias("hub"))
    rows = materialise(rows.join(hubs, "bucket").where("fp <> hub"), "spokes")
    shared = materialise(overlaps(rows.select(F.col("hub").alias("src"), F.col("fp").alias("dst")), said), "overlaps")
    found = shared.where(similar(F.col("shared"), F.col("sizes"))).select("src", "dst")
    rows = rows.join(shared.select(F.col("dst").alias("fp"), "shared"), "fp").withColumn("beside", F.col("held") - F.col("shared"))
    left = materialise(possible(_named(rows, found)).select("bucket", "hub", "fp", "component", "size", "shared"), "possible")
    if left.isEmpty():
        return found
    found, left = by_beside(found, left, said, block)
    return found.unionByName(_group_links(left.select("bucket", "fp"), said, block))


def by_beside(found: DataFrame, left: DataFrame, said: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """More edges, and what they leave of left(bucket, hub, fp, component, size, shared), of buckets with over `block` texts.

    Such a bucket holds families within a family. Texts with a least hash in common, of the shingles that they
    have beside the hub, are compared with one of them. Then only what is held by another component counts.
    """
    large = materialise(left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("bucket"), "large")
    if large.isEmpty():
        return found, left
    rows = left.join(large, "bucket", "left_semi")
    each = materialise(beside(rows, said), "beside")
    hashes = F.array(*[F.min(F.xxhash64(F.lit(i), "shingle")) for i in range(LEAST_HASHES)])
    keys = each.groupBy("bucket", "fp").agg(F.count(F.lit(1)).alias("n"), hashes.alias("hashes"))
    keys = keys.select("bucket", "fp", "n", F.posexplode("hashes").alias("at", "least"))
    hubs = keys.groupBy("bucket", "at", "least").agg(F.max(F.struct("n", "fp"))["fp"].alias("src"))
    pairs = keys.join(hubs, ["bucket", "at", "least"]).where("src <> fp").select("src", F.col("fp").alias("dst")).distinct()
    more = overlaps(pairs, said).where(similar(F.col("shared"), F.col("sizes"))).select("src", "dst")
    found = materialise(found.unionByName(more), "found")
    rows = materialise(_named(rows.drop("component"), found), "open")
    each = each.join(rows.select("fp", "component"), "fp")
    across = each.groupBy("bucket", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket", "shingle")
    counts = each.join(across, ["bucket", "shingle"]).groupBy("fp").agg(F.count(F.lit(1)).alias("beside"))
    rows = possible(rows.join(counts, "fp", "left").withColumn("beside", F.coalesce("beside", F.lit(0).cast("long"))))
    return found, materialise(rows.select(*left.columns).unionByName(left.join(large, "bucket", "left_anti").select(*left.columns)), "left")


def heads(docs: DataFrame, key: list[str], block: int = 256) -> DataFrame:
    """The key columns of one row of every component of near copies: the least, nulls last.

    Texts without words are copies of one another. Rows equal in the key are one row.
    """
    order = F.struct(*[c for k in key for c in (F.col(k).isNull().alias(f"no_{k}"), F.col(k).alias(k))])
    parts, bits = plan(docs.count())
    rows = with_prints(docs.select("text", *key), parts, bits).select("fp", "size", "sketch", "parts", order.alias("least"))
    dots = rows.groupBy("fp").agg(F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("size", "sketch", "parts")])
    dots = materialise(dots, "vertices")
    members = materialise(candidates(dots, bits), "members")
    wanted = members.join(dots, "fp").select("fp", *[F.col("least")[k].alias(f"of_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    said = materialise(docs.select("text", *key).join(wanted, on).select("fp", "text").dropDuplicates(["fp"]), "said")
    label = connected_components(links(members, dots.select("fp", "size"), said, block))
    whole = dots.join(label, dots.fp == label.node, "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("least").alias("least"))
    return whole.select(*[F.col("least")[k].alias(k) for k in key])
