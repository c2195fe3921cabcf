"""The pipeline's stages against brute force on small tables."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import near_copies


def jaccard(a, b, width=5):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    one, two = sets
    return len(one & two) / len(one | two) if one | two else 1.0


def test_near_copies(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((60, 120, 400)))]
        rows.append(" ".join(base))
        for changes in (0, 1, 2, 3, 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "changed"
            rows.append(" ".join(copy))
    common = [rng.choice(vocabulary) for _ in range(150)]
    chain = [" ".join(common[: 150 - 8 * i] + [f"x{i}y{j}" for j in range(8 * i)]) for i in range(15)]
    rows += [*chain, None, "", " ", "few words", "FEW  words"]
    ids = rng.sample(range(10_000), len(rows))
    table = [(None if i % 7 == 3 else ids[i], text, i) for i, text in enumerate(rows)]
    table.append((*table[0][:2], 999))
    label = list(range(len(table)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if jaccard(table[i][1], table[j][1]) >= 0.8:
                label[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(table):
        groups.setdefault(find(i), []).append(row)
    docs = spark.createDataFrame(table, "doc_id long, text string, hash long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert [f for f in kept[0].asDict()] == ["doc_id", "text", "hash"] and len(kept) == len(groups)
    by = {find(i): 0 for i in range(len(table))}
    place = {(r[0], r[1]): find(i) for i, r in enumerate(table)}
    for r in kept:
        group = place[r.doc_id, r.text]
        by[group] += 1
        known = [x[0] for x in groups[group] if x[0] is not None]
        assert r.doc_id == (min(known) if known else None)
    assert set(by.values()) == {1}


def test_covering_simhash(spark, monkeypatch):
    """Fingerprints by plain counting; no pair within the covered radius missed, in cut buckets too; no way to a link beside it."""
    rng = np.random.default_rng(7)
    for n in (1, 4, 5, 300, 2500):
        shingles = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        counts = [0] * 320
        for h in map(int, shingles):
            for word, times in enumerate(map(int, near_copies._TIMES[:10])):
                v = h * times % (1 << 64)
                for by in map(int, near_copies._MIX):
                    v = (v ^ v >> 33) * by % (1 << 64)
                digits = (v ^ v >> 33).to_bytes(8, "little")
                for bit in range(64):
                    counts[word % 5 * 64 + bit] += digits[bit // 8] >> (7 - bit % 8) & 1
        assert near_copies.fingerprint(shingles, 5).tolist() == [int(c * 2 > 2 * n) for c in counts]
    parts, bits = near_copies.plan(1000)
    sets = []
    for k in range(40):
        one = rng.integers(0, 2, (parts, bits))
        if k >= 20:
            one[0] = sets[0][0]  # a key that many share
        other = one.copy()
        for part in range(parts):
            at = rng.choice(bits, 1 if part == k % parts else 2, replace=False)
            other[part, at] ^= 1
        sets += [one, other]
    power = 1 << np.arange(bits)
    rows = [(i, np.packbits(s.ravel()[:192]).view(np.int64).tolist(), (s @ power).tolist()) for i, s in enumerate(sets)]
    prints = spark.createDataFrame(rows, "fp long, sketch array<long>, parts array<long>")
    for block in (1024, 6):
        groups = {}
        for r in near_copies.candidates(prints, bits, block).collect():
            groups.setdefault(r.bucket, set()).add(r.fp)
        assert set(map(frozenset, groups.values())) == {frozenset((i, i + 1)) for i in range(0, 80, 2)}
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words).upper())], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]
    monkeypatch.setattr(near_copies, "candidates", lambda prints, bits: spark.createDataFrame([], "bucket long, fp long"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_shared_shingles_are_counted_in_ranges():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 40, 900, 2500, 2500)] + [np.array([0, (1 << 64) - 1], np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for at_once in (1, 7, 100, 1 << 20):
        got = near_copies.shared_counts(sets, step=64, at_once=at_once)
        off = ~np.eye(len(sets), dtype=bool)
        assert (got[off] == np.array(want)[off]).all()


def test_all_pairs_of_a_bucket(spark):
    """Links between vertices that their bucket's least vertex is not like, and buckets cut into parts."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base, *[f"{k}t{j}" for j in range(k * 3)]]) for k in range(20)]
    said = spark.createDataFrame(list(enumerate(texts)), "fp long, text string")
    links = near_copies._group_links(said.selectExpr("1L as bucket", "fp"), said, block=6)
    got = {r.node: r.component for r in near_copies.connected_components(links).collect()}
    near = {(i, j) for i in range(20) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    label = list(range(20))
    for _ in label:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    assert near and all(got.get(i, i) == label[i] for i in range(20))


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Near copies of one text: what their hub and the shingles held by others settle is not dealt again; no link is lost."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(140)]

    def edited(changes, word):
        copy = list(base)
        for k, at in enumerate(sorted(rng.sample(range(5, 135), changes))):
            copy[at] = f"{word}x{k}"
        return copy

    texts = [base, *[edited(1 + i % 2, f"a{i}") for i in range(150)], *[edited(4 + i % 2, f"b{i}") for i in range(150)]]
    for i in range(4):  # two that are near each other and not the rest
        one = edited(5, f"c{i}")
        other = list(one)
        other[60] = f"d{i}"
        texts += [one, other]
    texts = [" ".join(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = [near_copies.shingle_set(t) for t in texts]
    shared = near_copies.shared_counts(sets)
    for i in range(len(texts)):
        for j in range(i):
            if shared[i, j] * 5 >= 4 * (len(sets[i]) + len(sets[j]) - shared[i, j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    assert len(want) > 100 and any(find(i) == i - 1 for i in range(301, len(texts)))
    dealt = []
    whole = near_copies._group_links

    def counted(members, said, block):
        dealt.append(members.count())
        return whole(members, said, block)

    monkeypatch.setattr(near_copies, "_group_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert sum(dealt) <= len(texts), dealt


def test_a_key_of_a_large_family_is_not_dealt_by_pairs_of_parts(spark, monkeypatch):
    """Candidates against brute force where all share a key; the rows dealt follow the family's size, and a group lists a vertex once."""
    rng = np.random.default_rng(4)
    apart = near_copies.most_apart(64 * near_copies.SKETCH, near_copies.COSINE, near_copies.SKETCH_MISS)

    def flipped(bits, changes):
        other = bits.copy()
        other[rng.choice(len(bits), changes, replace=False)] ^= 1
        return other

    base = rng.integers(0, 2, 192, dtype=np.uint8)
    sketches = [flipped(base, int(rng.integers(1, 20))) for _ in range(400)]
    sketches += [flipped(sketches[k], 46) for k in range(12)]  # most are near one member, or a few
    sketches += [flipped(sketches[400 + k], 46) for k in range(4)]  # and these only to those
    lone = [rng.integers(0, 2, 192, dtype=np.uint8) for _ in range(6)]
    sketches += [*lone, flipped(lone[0], 30)]
    words = [np.packbits(x).view(np.int64).tolist() for x in sketches]
    prints = spark.createDataFrame([(i, w, [7]) for i, w in enumerate(words)], "fp long, sketch array<long>, parts array<long>")
    near = np.array([[int((a != b).sum()) <= apart for b in sketches] for a in sketches])
    label = near_copies.buckets.roots(len(sketches), *np.nonzero(np.triu(near, 1)))
    want = {i: int(x) for i, x in enumerate(label) if (label == x).sum() > 1}
    assert 2 <= len(set(want.values())) and len(want) < len(sketches)
    dealt, whole = [], near_copies._near

    def counted(rows, again=False):
        dealt.append(rows.count())
        return whole(rows, again)

    monkeypatch.setattr(near_copies, "_near", counted)
    for block, most in ((1024, 1), (20, 3), (7, 8)):
        got = near_copies.candidates(prints, 15, block).collect()
        assert {r.fp: r.bucket for r in got} == want and len(got) == len(want)
        assert sum(dealt) <= most * 3 * len(sketches), (block, dealt)
        dealt.clear()


def test_families_within_a_family(spark, monkeypatch):
    """Groups of near copies of copies that are not near: no link is lost, and what is dealt pair by pair is less than the texts."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(140)]

    def edited(words, at, word):
        copy = list(words)
        for k in at:
            copy[k] = f"{word}x{k}"
        return copy

    texts = [base]
    for c in range(14):
        centre = edited(base, rng.sample(range(5, 135), 4), f"c{c}")
        texts += [edited(centre, [rng.randrange(5, 135)], f"m{c}n{i}") for i in range(30)]
    texts = [" ".join(t) for t in texts]
    sets = [near_copies.shingle_set(t) for t in texts]
    shared, size = near_copies.shared_counts(sets), np.array([len(s) for s in sets])
    label = near_copies.buckets.roots(len(sets), *np.nonzero(np.triu(near_copies.similar(shared, size[:, None] + size[None, :]), 1)))
    want = sorted({int(x) for x in label})
    assert 5 < len(want) < len(texts) / 2
    dealt, whole = [], near_copies._group_links

    def counted(members, said, block):
        dealt.append(members.count())
        return whole(members, said, block)

    monkeypatch.setattr(near_copies, "_group_links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert sum(dealt) < len(texts), dealt


def test_rounded_counts_lose_no_pair(spark):
    """Which texts may be similar, by counts of any size, against all pairs; nothing of one component stays."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        size = int(rng.integers(5, 5000)) if i % 2 else int(rng.integers(100, 140))
        shared = int(rng.integers(size * 6 // 10, size + 1))
        rows.append((i % 3, i, int(rng.integers(0, 40)), size, shared, int(rng.integers(0, max(1, size - shared) + 1))))
    rows += [(9, 1000 + i, 5, 100, 100, 0) for i in range(5)]
    table = spark.createDataFrame(rows, "bucket long, fp long, component long, size long, shared long, beside long")
    may = {r[1] for r in rows for q in rows if r[0] == q[0] and r[2] != q[2] and near_copies.similar(min(r[4], q[4]) + min(r[5], q[5]), r[3] + q[3])}
    small = {r[1] for r in rows if r[3] < 256}
    for block in (512, 8):
        got = [r.fp for r in near_copies.possible(table, block).collect()]
        assert len(got) == len(set(got)) and may <= set(got) and not any(i >= 1000 for i in got)
        assert {i for i in got if i in small} - may == set() or len(got) < len(rows)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empties, repeats, clashing names and an empty table, through every stage and run()."""
    words = {"en": ["the", "water", "thing", "house", "with", "stone", "river"], "de": ["der", "wasser", "schule", "haus", "nicht", "stein", "fluss"]}
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "n"]) for _ in range(70)) + (" idiot moron" if i % 6 == 0 else ""), lang, "s", 9, 0.5, "x"))
        marks.append((i, 1, int(i % 6 == 0)))
    odd = [(200, None), (201, ""), (202, "12 34 !"), (203, rows[1][1]), (204, rows[1][1]), (None, rows[3][1]), (None, None), (205, rows[5][1] * 60)]
    rows += [(i, t, None, None, None, None, None) for i, t in odd] + [rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")
    spoken = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert spoken.schema.names == docs.schema.names and {r.doc_id for r in spoken.collect()} == set(range(120)) | {203, 204, 205, None}
    clean = corpus_pipeline.toxic(spark, spoken, str(tmp_path))
    assert clean.schema.names == docs.schema.names and sorted(map(key, clean.collect())) == sorted(key(r) for r in spoken.collect() if "idiot" not in r.text)
    kept = corpus_pipeline.near_duplicates(spark, clean, str(tmp_path))
    left = sorted(map(key, kept.collect()))
    assert jaccard(rows[5][1], rows[5][1] * 60) >= 0.8  # a text said over again has hardly another shingle
    assert [k for k, _ in left] == [i for i in range(120) if i % 6]
    pieces = corpus_pipeline.pack(spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {k for k, _ in left}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["language ID", "toxicity"] and len(corpus_pipeline.STAGES) == 4
