"""The ten operators over their whole tables, with production parameters, and what SQL can say of them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann_hilbert, bpe_codec, embed_dedup, langid, packing, quality_fm, sharding, simhash, token_counts, toxicity
from .common import read, remainder


def op1_quality_fm(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality_fm.score(docs.select("doc_id", "text", "n_chars"), quality_fm.fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_hyperplane_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_covering_simhash(spark, sf_dir):
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_hilbert_neighbours(spark, sf_dir):
    table = read(spark, sf_dir, "embeddings")
    return ann_hilbert.nearest(table, table.where(F.col("vec_id") % 50 == 0))


def op6_language_spans(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_deobfuscated_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_uniform_shards(spark, sf_dir):
    return sharding.uniform_shards(read(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op10_bpe_codec(spark, sf_dir):
    return bpe_codec.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True)


def queries():
    return {f.__name__: f for f in (op1_quality_fm, op2_hyperplane_dedup, op3_covering_simhash, op4_harmonic_packing, op5_hilbert_neighbours, op6_language_spans, op7_deobfuscated_toxicity, op8_uniform_shards, op9_token_counts, op10_bpe_codec)}


#: The least id a vector reaches: smaller ids travel along links towards larger ones, which every path from a component's least id does.
_OP2 = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.9),
reach AS (
    SELECT vec_id AS node, vec_id AS least FROM embeddings
    UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node WHERE r.least < l.b),
named AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN named m ON m.node = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""


def oracle_sql():
    """SQL for the whole result where there is any: for ids that are there and do not repeat."""
    return {"op2_hyperplane_dedup": _OP2}
