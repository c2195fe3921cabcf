"""From raw documents to packed sequences: language ID, toxicity, near-duplicates, packing.

Every stage reads what the one before it wrote. The first three keep or drop whole rows of
`documents`; the last returns the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, near_copies, packing, toxicity
from tessera.llm.common import materialise, read, ship

#: A document whose letters are surely of one language to less than this share has no language.
LEAST_SHARE = 0.35
#: Rows of a batch on its way to a Python worker, where the session does not say: texts are long, and a batch is held on both sides.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def begin(spark: SparkSession) -> None:
    ship(spark)
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def beside(docs: DataFrame) -> DataFrame:
    """text, and the other columns as `row`, out of the way of an operator's own names."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))


def back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return found.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those in which no language prevails."""
    begin(spark)
    found = langid.identify(beside(docs), langid.fit(docs))
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are likelier toxic than not."""
    begin(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    found = toxicity.score(beside(docs), model)
    return back(found.where(F.col("predicted") == 0), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of least doc_id of every group of near copies, once; a row without an id only if none has one.

    Near copies share 0.8 or more of their five-word shingles, directly or by way of others.
    """
    begin(spark)
    marks = {"crc": F.crc32(F.coalesce("text", F.lit(""))), "hash": F.xxhash64("text")}
    names = {"doc_id": F.col("doc_id"), **marks}
    heads = near_copies.heads(docs.select("text", *[c.alias(n) for n, c in names.items()]), list(names))
    heads = materialise(heads, "heads").select(*[F.col(n).alias(f"head_{n}") for n in names])
    whole = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in names.items()])
    same = F.col("doc_id").eqNullSafe(F.col("head_doc_id")) & (F.col("crc") == F.col("head_crc")) & (F.col("hash") == F.col("head_hash"))
    return whole.join(heads, same, "left_semi").dropDuplicates(list(names)).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequences they stand in."""
    begin(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language ID", language), ("toxicity", toxic), ("near-duplicates", near_duplicates), ("packing", pack)]
#: No stage but the driver's comparison could follow Viterbi paths, learned weights or merges in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
