"""The training-data operators against brute force, the libraries and held-out labels, on small tables."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import ann_hilbert, bpe, bpe_codec, common, embed_dedup, labelled, langid, packing, quality_fm, queries, sharding, simhash, token_counts, toxicity
from tessera.llm.common import ship

ODD = [None, "", " ", "\n\n", "a  b\t c\n d", "don't  stop!! 12 ½ é", "日本語 text 🙂", "<|endoftext|> x <|startoftext|>", "the cat " * 3000, "the cat sat on the mat.", "the cat sat on the mat."]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, s, None if i % 3 else "en", None, "clash") for i, s in enumerate(ODD)] + [(None, "no id", "en", 1, "x"), (9, ODD[9], "en", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, score string")


def test_token_counts(docs):
    tok = bpe.library(P.path("word_bpe_49k.json"))
    for r in token_counts.token_counts(docs, P.path("word_bpe_49k.json")).collect():
        assert r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())


def test_codec(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.tiktoken_encoding(path, P.PATTERN)
    got = bpe_codec.encode(docs, path, P.PATTERN, block_chars=100)
    want = sorted((-1 if r.doc_id is None else r.doc_id, enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, bytes(r.decoded)) for r in got.collect()) == want
    assert all(bytes(r.decoded) == bytes(r.again) for r in bpe_codec.decode(got.withColumnRenamed("decoded", "again"), path).collect())
    digests = bpe_codec.encode(docs.where("doc_id = 8"), path, P.PATTERN, digests_only=True).first()
    assert digests.decoded_sha256 == hashlib.sha256(ODD[8].encode()).hexdigest()


def test_codec_of_equal_blocks(spark, docs):
    """Repeated tasks, and tasks whose rows differ only in the words."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.tiktoken_encoding(path, P.PATTERN)
    alike = [spark.createDataFrame([(None, s)], "doc_id long, text string").coalesce(1) for s in ("a b", "c d", "c d")]
    once = docs.select("doc_id", "text")
    for table in (once.union(once), alike[0].union(alike[1]).union(alike[2])):
        got = bpe_codec.encode(table, path, P.PATTERN, block_chars=100).collect()
        key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")
        want = sorted((key(r)[0], enc.encode_ordinary(key(r)[1]), key(r)[1].encode()) for r in table.collect())
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, bytes(r.decoded)) for r in got) == want


def test_packing(docs):
    path = P.path("byte_bpe_50k.json")
    tok = bpe.library(path)
    rows = packing.pack(docs, path, P.PATTERN, with_ids=True, capacity=64, classes=8).collect()
    for doc_id in range(len(ODD)):
        pieces = sorted((r.start, r.ids, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc_id)
        want = tok.encode(ODD[doc_id] or "", add_special_tokens=False).ids + [1]
        times = 2 if doc_id == 9 else 1
        assert sum(len(p[1]) for p in pieces) == times * len(want)
        for start, ids, crc, total in pieces:
            assert ids == want[start : start + len(ids)] and crc == zlib.crc32(np.array(ids, "<u4").tobytes()) and total == len(want)
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 64


def test_shards(spark, docs):
    rows = sharding.uniform_shards(spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")), shards=8).collect()
    for s in range(8):
        slots = sorted(r.slot for r in rows if r["shard"] == s)
        assert slots == list(range(1003 // 8 + (s < 1003 % 8)))
    assert sorted(r.text_crc32 for r in sharding.uniform_shards(docs).collect()) == sorted(zlib.crc32((s or "").encode()) for s in [*ODD, "no id", ODD[9]])


def test_hypergeometric(spark):
    u = (F.col("id") + 0.5) / 20_000
    got = spark.range(20_000).select(sharding.hypergeometric(F.lit(50), F.lit(20), F.lit(10), u).alias("k")).groupBy("k").count().collect()
    from math import comb
    for r in got:
        assert abs(r["count"] / 20_000 - comb(20, r.k) * comb(30, 10 - r.k) / comb(50, 10)) < 2e-4


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    assert all(simhash.fingerprint(s) == brute_fingerprint(s) for s in ODD)
    masks = simhash.masks(2)
    assert all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a in range(64) for b in range(64))
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base for _ in range(12)} | set(base))
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    got = {r.node: r.component for r in simhash.classes(df).collect()}
    label = list(range(len(prints)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[max(find(i), find(j))] = min(find(i), find(j))
    for i in range(len(prints)):
        for j in range(i):
            a, b = got.get(simhash._signed(prints[i])), got.get(simhash._signed(prints[j]))
            assert (find(i) == find(j)) == (a is not None and a == b)
    rows = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert rows[9].component_id == rows[10].component_id == 9 and rows[0].fingerprint == "0" * 16 and rows[3].component_id == 0


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    data = [v.tolist() for v in np.concatenate([base, base[:20] + 0.15 * rng.normal(size=(20, 16)), base[:5], base[:1] + 0.1 * rng.normal(size=(100, 16))])]
    bad = [None, [0.0] * 16, [None] * 16, [float("nan")] * 16, [1.0, float("inf")] * 8, []]
    return data, spark.createDataFrame([(i, v, "x") for i, v in enumerate([*data, *bad])], "vec_id long, embedding array<float>, label string")


def test_embeddings(spark):
    ship(spark)
    data, table = vectors(spark)
    a = np.array(data, "f4").astype("f8")
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = a @ a.T >= 0.9
    rows = {r.vec_id: r for r in embed_dedup.near_duplicates(table, block=16, per_bucket=8).collect()}
    assert len(rows) == len(data) + 6
    reach = near.copy()
    for _ in range(8):
        reach = reach @ reach
    for i in range(len(data)):
        assert rows[i].n_links == near[i].sum() - 1 and rows[i].component_id == np.flatnonzero(reach[i])[0]
    assert all(rows[len(data) + k].n_links == 0 and rows[len(data) + k].kept for k in range(6))
    found = ann_hilbert.nearest(table, table.where("vec_id % 5 = 0"), range_rows=16).collect()
    score = a @ a.T
    np.fill_diagonal(score, -9)
    hits = 0
    asked = [q for q in range(len(data)) if q % 5 == 0]
    for q in asked:
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - score[q, m[1]]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & set(np.argsort(-score[q], kind="stable")[:5].tolist()))
    assert hits >= 0.9 * 5 * len(asked)


def test_neighbours_of_ties_and_lengths(spark):
    """Ties go to the smaller id, vectors of another length take no part, doubles keep their precision."""
    ship(spark)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6))
    rows = [*base, *[2 * base[0]] * 4, *[base[0] * (2.0**i) for i in range(-4, 0)], *rng.normal(size=(20, 3))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    table = table.unionByName(table.where("vec_id = 7"))
    found = ann_hilbert.nearest(table, table.where("vec_id in (0, 7, 310)"), share=1.0, range_rows=64).collect()
    for query in (0, 7, 310):
        alike = [i for i in range(len(rows)) if len(rows[i]) == len(rows[query]) and i != query]
        cosine = {i: rows[i] @ rows[query] / np.linalg.norm(rows[i]) / np.linalg.norm(rows[query]) for i in alike}
        want = sorted(alike, key=lambda i: (-round(cosine[i], 12), i))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert [m[1] for m in mine] == want and all(abs(m[2] - cosine[m[1]]) < 1e-12 for m in mine)


def test_classifiers_and_language(spark, docs):
    rng = random.Random(5)
    words = {"en": ["the", "water", "thing", "house", "with"], "de": ["der", "wasser", "schule", "haus", "nicht"]}
    rows, labels = [], []
    for i in range(160):
        lang, bad = ("en", "de")[i % 2], i % 4 == 0
        text = " ".join(rng.choice(words[lang]) for _ in range(60))
        rows.append((i, text + (" idiot" if i % 5 == 0 else "") + (" $$$ ###" * 20 if bad else ""), lang, len(text)))
        labels.append((i, int(not bad), int(i % 5 == 0)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    scored = quality_fm.score(table, quality_fm.fit(table, marks)).collect()
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in scored]) > 0.95
    model = toxicity.fit(table, marks)
    assert all(r.predicted == truth[r.doc_id][1] for r in toxicity.score(table, model).collect())
    hidden = spark.createDataFrame([(1, "the 1d10t water"), (2, "i d i o t house"), (3, "the house with water"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(hidden, model).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    tongue = langid.fit(table)
    assert np.mean([r.lang_pred == r.lang for r in langid.identify(table, tongue).collect()]) > 0.98
    mixed = langid.identify(spark.createDataFrame([(1, "the water thing house with " * 6 + "der wasser schule haus nicht " * 3), (2, "12 !"), (3, None)], "doc_id long, text string"), tongue, with_spans=True).collect()
    assert [s.lang for s in mixed[0].spans] == ["en", "de"] and mixed[0].lang_pred == "en" and [m.lang_pred for m in mixed[1:]] == ["und", "und"]
    assert quality_fm.score(docs, quality_fm.fit(docs, marks.limit(0))).count() == docs.count()


def test_letters_are_counted_over_all_documents(spark):
    """Unlabelled documents and labelled ones beyond the cap steer the decoding."""
    ship(spark)
    rows = [(i, "stone Stone" if i < 20 else "b0und bound" if i < 40 else "quartz") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks, per_class=2).model
    said = {}
    for _, text in rows:
        for w in set(re.findall("[a-z]+", text.lower())):
            said[w] = said.get(w, 0) + 1
    assert said == {"stone": 20, "b": 20, "und": 20, "bound": 20, "quartz": 20}
    want = {}
    for w, n in said.items():
        for i in range(len(w) + 1):
            gram = f"  {w} "[i : i + 3]
            want[gram] = want.get(gram, 0) + n
    assert model.three == want and model.two["  "] == 100 and model.two["qu"] == model.one["q"] == 20 and model.total == sum(want.values())
    assert toxicity.restore("qu@rtz", model) == ["quartz"]


def test_path_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.normal(size=(6, 3)) * 3
        got = langid.path(s, 2.0)
        value = lambda p: s[np.arange(6), list(p)].sum() - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        assert abs(value(got) - max(value(p) for p in np.ndindex(3, 3, 3, 3, 3, 3))) < 1e-9


def test_paths_of_many_texts_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(60):
        many = [rng.normal(size=(n, 3)) * 6 * (rng.random((n, 1)) < 0.7) for n in (1, 5, 6, 4)]
        for s, got in zip(many, langid.paths(many, 2.0), strict=True):
            value = lambda p: s[np.arange(len(s)), list(p)].sum() - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
            assert abs(value(got) - max(value(p) for p in np.ndindex(*[3] * len(s)))) < 1e-9


def test_labels_that_tell_nothing_call_nothing_toxic(spark):
    ship(spark)
    table = spark.createDataFrame([(i, "the house and water") for i in range(30)], "doc_id long, text string")
    for marks in ([(i, int(i < 4)) for i in range(30)], [(i, 0) for i in range(30)], []):
        model = toxicity.fit(table, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert not model.weights and all(r.predicted == 0 for r in toxicity.score(table, model).collect())


def test_telling_features_are_few_where_labels_are():
    assert toxicity.telling([("bad", 4, 4), ("odd", 2, 2)], {1: 3000, 2: 400, 3: 90, 4: 40}, 0.13, 512, 0.5) == ["bad"]
    assert toxicity.telling([("bad", 2, 2)], {1: 3000, 2: 400}, 0.13, 512, 0.5) == []
    tail = toxicity.tails(5, 0.3)
    assert abs(tail[0] - 1) < 1e-12 and abs(tail[5] - 0.3**5) < 1e-12 and abs(tail[4] - (0.3**5 + 5 * 0.3**4 * 0.7)) < 1e-12


def test_a_lattice_is_decoded_as_its_best_path():
    """restore() against every way through the lattice."""
    words = {"idiot": 40, "stupid": 30, "dot": 10, "it": 50, "do": 30, "is": 40, "to": 60}
    model = toxicity.char_model(toxicity.trigrams(words))

    def ways(s, i=0):
        if i == len(s):
            yield 0.0, ""
            return
        ch, repeat = s[i], i > 0 and s[i - 1] == s[i]
        options = []
        if ch.isalpha():
            options.append((ch, toxicity.SAID))
            if repeat:
                options.append(("", 0.0 if i > 1 and s[i - 2] == ch else toxicity.DROPPED_REPEAT))
        elif ch in toxicity._SEPARATORS and ch not in toxicity.LEET:
            options += [("", toxicity.SAID), (" ", toxicity.WORD_END)]
        else:
            options += [(c, toxicity.IMITATED) for c in toxicity.LEET.get(ch, "")] + [("", toxicity.SAID if repeat else toxicity.DROPPED_SIGN)]
            if ch in toxicity._SEPARATORS:
                options.append(("", toxicity.SAID))
        for c, cost in options:
            for rest, tail in ways(s, i + 1):
                yield cost + rest, c + tail

    def value(said):
        if said.startswith(" ") or "  " in said:
            return -math.inf
        total = 0.0
        for word in said.split(" "):
            padded = f"  {word} " if word else ""
            total += sum(model.logp(*padded[i - 2 : i + 1]) for i in range(2, len(padded)))
        return total

    for stretch in ("1d10t", "i d-i0t", "stuuup1d", "i_t", "d00t", "s*up!d", "t.o"):
        best = max((cost + value(said), said) for cost, said in ways(stretch))
        got = toxicity.restore(stretch, model)
        scores = [cost + value(said) for cost, said in ways(stretch) if said.split() == got]
        assert scores and abs(max(scores) - best[0]) < 1e-9, (stretch, got, best)


def test_deobfuscation_gates():
    words = {"stupid": 60, "idiot": 60, "loser": 50, "the": 300, "house": 50, "and": 200, "well": 40, "known": 40, "on": 200, "mor": 9}
    toxic = toxicity.Toxic(toxicity.char_model(toxicity.trigrams(words)), {"stupid": 3.0, "idiot": 3.0, "loser": 2.0, "lowei--": 2.0}, -1.0)
    scorer = toxicity.Scorer(toxic)
    for text in ("stu-pid", "st.up.id", "s t u pid house", "s t u p i d and the", "$tup1d", "stuuupid", "sstupid", "ｓｔｕｐｉｄ"):
        assert scorer.words(text) == {"stupid"}, text
    for text in ("stu pid", "455 is on the house", "well-known", "the house and", "12-34", None, "", "   "):
        assert scorer.words(text) == set(), text
    assert scorer.words("i d i o t") == {"idiot"} and scorer.words("loweian loweien") == {"lowei--"} and scorer.words("loweian") == set()
    long = "x1" * 20_000 + " id" + "i" * 1000 + "ot"
    assert 0 < scorer(long) < 1 and len(scorer) < 50 and all(len(c) <= toxicity.LONGEST for c in scorer)


def test_one_row_of_a_repeated_id_is_fitted(spark):
    ship(spark)
    table = spark.createDataFrame([(7, f"text {i}") for i in range(5000)] + [(8, None), (8, "said"), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (None, 1)], "doc_id long, toxic int")
    found, counts = labelled.fitting_sample(table, marks, "toxic", 10, modulus=1000)
    rows = sorted(map(tuple, found.select("doc_id", "text", "label").collect()))
    assert [(r[0], r[2]) for r in rows] == [(7, 1), (8, 0)] and rows[1][1] == "said" and counts == {0: 1, 1: 1}


def test_machine_sums_pairs_and_its_gradient_is_right():
    rng = np.random.default_rng(6)
    k, size = len(quality_fm.STATS), 12
    m = quality_fm.Machine(0.3, rng.normal(size=size + k), rng.normal(size=(size + k, 4)), np.zeros(k), np.ones(k))
    rows = [(np.r_[rng.choice(size, 5, replace=False), size : size + k], np.r_[rng.normal(size=5), rng.normal(size=k)], int(y)) for y in (0, 1, 1)]
    for i, x, _ in rows:
        z = m.standard(x)
        pairs = sum((m.v[i[a]] @ m.v[i[b]]) * z[a] * z[b] for a in range(len(i)) for b in range(a))
        assert abs(m.raw(i, x) - (m.w0 + z @ m.w[i] + pairs)) < 1e-9
    weight = {0: 1.5, 1: 0.75}
    part = [(i, m.standard(x), y) for i, x, y in rows]

    def loss():
        out = 0.0
        for i, x, y in rows:
            z = m.raw(i, x)
            out += weight[y] * (math.log1p(math.exp(-z)) + (1 - y) * z) / len(rows)
        return out

    u, dw, dv, d0 = quality_fm.gradient(m, part, weight)

    def slope(array, at):
        step = 1e-6
        array[at] += step
        high = loss()
        array[at] -= 2 * step
        low = loss()
        array[at] += step
        return (high - low) / (2 * step)

    for n, f in enumerate(u):
        assert abs(slope(m.w, f) - dw[n]) < 1e-6 and all(abs(slope(m.v, (f, r)) - dv[n, r]) < 1e-6 for r in range(4))
    m.w0 += 1e-6
    high = loss()
    m.w0 -= 2e-6
    assert abs((high - loss()) / 2e-6 - d0) < 1e-6


def test_counts_of_every_fast_code_point():
    """Each character that the fast path takes, at the start, in the middle and at the end of whole-word tokens."""
    path = P.path("word_bpe_49k.json")
    tok = bpe.library(path)
    lengths = token_counts.Lengths(path, token_counts.frequent_lengths(path), 10**6)
    texts = [t for c in map(chr, range(1, 0x300)) for t in (f"{c}gardener", f"gar{c}dener", f"gardener{c}", f"mountains{c} Mountains {c} it's{c}s")]
    texts += ["Əlaqə Ɛdɛ Ɓala gardenerȺ", "mountainsȺ mountainsȾ", "“quoted” – word … don't", "ΑΣ ΣΑΣ", "e\u0301 \u0301x", "日本 the house語", "a\u00a0b\u2028c\x0bd", "x" * 5000 + " é"]
    for t in texts:
        assert lengths.count(t) == len(tok.encode(t, add_special_tokens=False).ids), repr(t)
    assert all(len(c) <= bpe.LONGEST for c in lengths)


def test_other_vocabularies_go_through_the_library(tmp_path):
    """The same merges with a space put before the text, or with another split, are not the fast path's."""
    import json

    spec = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    assert bpe.json_encoding(P.path("byte_bpe_50k.json"), P.PATTERN) is not None
    for n, change in enumerate(({"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}, {"normalizer": {"type": "Lowercase"}})):
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        encode, tok = bpe.JsonEncoder(str(path), P.PATTERN), bpe.library(str(path))
        for s in ("hello world", "Don't  stop"):
            assert np.frombuffer(encode(s), "<u4").tolist() == tok.encode(s, add_special_tokens=False).ids


def test_equal_rows_are_shuffled(spark):
    rows = sharding.uniform_shards(spark.range(10_000).selectExpr("if(id < 1000, 5, id) AS doc_id", "if(id < 1000, 'same', cast(id AS string)) AS text"), rows_per_bucket=100, group_width=8).collect()
    for s in range(8):
        mine = sorted((r.slot, r.doc_id) for r in rows if r["shard"] == s)
        assert [a for a, _ in mine] == list(range(1250))
        equal = [a for a, d in mine if d == 5]
        assert 75 < len(equal) < 175 and sum(b - a == 1 for a, b in zip(equal, equal[1:], strict=False)) < 40


def test_short_texts_are_packed_tightly(spark):
    """Thousands of repeated short rows: a tree of workers, the smallest class by size, no gap and no clash."""
    ship(spark)
    path = P.path("byte_bpe_50k.json")
    table = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", "'a b c d e f g h i j' AS text")
    rows = packing.pack(table, path, P.PATTERN, rows_per_worker=50, fan=4).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert sum(by.values()) == 33_000 and max(by.values()) <= 2048 and len(by) <= 19


def test_packed_numbers_round_trip():
    for x in (np.r_[0, 1, 127, 128, 129, 16383, 16384, 2**31 - 1, 5], np.empty(0, np.int64)):
        assert (bpe_codec.unpacked(bpe_codec.packed(x)) == x).all()


def test_names_that_clash_and_long_texts(spark):
    ship(spark)
    long = "the water house " * 40_000 + "idiot"
    table = spark.createDataFrame([(i, s, "en", "c", 0, "l", [1]) for i, s in enumerate([*ODD, long])], "doc_id long, text string, lang string, score string, predicted int, lang_pred string, spans array<int>")
    model = toxicity.Toxic(toxicity.char_model(toxicity.trigrams({"idiot": 5, "water": 9})), {"idiot": 5.0}, -1.0)
    scored = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert len(scored) == len(ODD) + 1 and scored[len(ODD)].predicted == 1 and scored[0].predicted == 0
    found = {r.doc_id: r for r in langid.identify(table, langid.fit(table), with_spans=True).collect()}
    assert found[len(ODD)].lang_pred == "en" and found[0].lang_pred == "und" and found[1].spans == []
    counted = token_counts.token_counts(table.withColumn("n_tokens", F.lit("x")), P.path("word_bpe_49k.json"))
    assert counted.schema["n_tokens"].dataType.simpleString() == "bigint" and counted.count() == len(ODD) + 1
    stray = table.select("doc_id", "text", F.concat(F.lit("l"), "doc_id").alias("lang"))
    assert len(langid.fit(stray, languages=3).names) == 3


def test_repeated_vectors_and_ids(spark):
    ship(spark)
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    rows = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embed_dedup.near_duplicates(table).collect())
    assert rows == [(0, 0, 0, False), (1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_same_vectors_as_sql(spark, tmp_path):
    ship(spark)
    table = vectors(spark)[1]
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    name = "op2_hyperplane_dedup"
    mine = queries.queries()[name](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()
    theirs = con.sql(queries.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, mine)) == sorted(theirs) and any(r.n_links for r in mine)


CONTRACTS = {
    "op1_quality_fm": "doc_id held_out score predicted", "op2_hyperplane_dedup": "vec_id n_links component_id kept", "op3_covering_simhash": "doc_id fingerprint component_id",
    "op4_harmonic_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op5_hilbert_neighbours": "query_id rank vec_id score", "op6_language_spans": "doc_id held_out lang_pred score",
    "op7_deobfuscated_toxicity": "doc_id held_out score predicted", "op8_uniform_shards": "doc_id size text_crc32 law shard slot grown_shard", "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op10_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contracts(spark, name):
    """The registered queries on the smallest tables: columns, whole tables, the rules for held_out and predicted."""
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    found = queries.queries()[name](spark, sf)
    assert set(CONTRACTS[name].split()) <= set(found.columns)
    rows = found.collect()
    docs = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    if "doc_id" in found.columns:
        assert sorted(r.doc_id for r in rows) == docs if name != "op4_harmonic_packing" else {r.doc_id for r in rows} == set(docs)
    if "held_out" in found.columns:
        modulus, rest = (4, 2) if name.startswith("op6") else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in rows)
    if "predicted" in found.columns:
        cut = 0.3 if name.startswith("op1") else 0.5
        assert all(r.predicted == int(r.score >= cut) for r in rows)
    if name.startswith("op5"):
        assert all(r.query_id % 50 == 0 for r in rows) and {r["rank"] for r in rows} == {1, 2, 3, 4, 5} and len(rows) == 5 * len({r.query_id for r in rows})


def test_intermediate_tables_are_removed_on_demand(spark, monkeypatch):
    monkeypatch.setattr(common, "_WRITTEN", {})
    table = common.materialise(spark.range(3), "three")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert table.count() == 3 and folder.exists()
    assert common.clear(spark) == 1 and not folder.exists() and common.clear(spark) == 0


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert token_counts.token_counts(none, P.path("word_bpe_49k.json")).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert sharding.uniform_shards(none).count() == 0 and simhash.simhash_groups(none).count() == 0
    assert bpe_codec.encode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    table = vectors(spark)[1].where("false")
    assert embed_dedup.near_duplicates(table).count() == 0 and ann_hilbert.nearest(table, table).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_fm.score(none, quality_fm.fit(none, marks)).count() == 0 and toxicity.score(none, toxicity.fit(none, marks)).count() == 0


def test_a_worker_keeps_one_operators_caches(spark):
    rows = spark.range(0, 64, 1, 16).select("id")
    schema = T.StructType([T.StructField("pid", T.LongType()), T.StructField("made", T.StringType()), T.StructField("slots", T.LongType())])

    def uses(key):
        def make():
            import os
            import uuid

            mine = common.kept(key, lambda: uuid.uuid4().hex)
            return lambda batch: pa.RecordBatch.from_pylist([{"pid": os.getpid(), "made": mine, "slots": len(common._KEPT)}], schema=pa.schema([("pid", pa.int64()), ("made", pa.string()), ("slots", pa.int64())]))

        return common.map_arrow(rows, make, schema).collect()

    one, other = uses("one"), uses("other")
    for found in (one, other):  # many tasks, one making a worker
        assert len(found) == 16 and len({r.made for r in found}) == len({r.pid for r in found})
        assert all(r.slots == 1 for r in found)
    assert not {r.made for r in one} & {r.made for r in other}
