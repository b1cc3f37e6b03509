"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import exact_dedup, jaccard, mixing, packing, quality_rules
from tapeloom.llm.common import fresh
from tapeloom.storage import remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines.

    Null, empty and short texts are rejected; every row is judged for itself,
    so repeated rows stay or go together.
    """
    return quality_rules.clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of identical texts: that with the largest doc_id.

    A null text counts as empty and a null doc_id only wins where there is no
    other; of rows that repeat doc_id and text one stays.
    """
    return exact_dedup.drop_exact_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    The multi-index over SimHash fingerprints links sets within two bits, MinHash
    bands find the similar sets that lie further apart, and whole sets decide. That with the smallest doc_id stays, nulls last. Texts without words are
    one group. Rows that repeat a doc_id are decided each for itself.
    """
    return jaccard.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; the last one may be cut to its first words.

    A null source is a source; texts without words are not taken. Each row of a
    repeated doc_id has a take of its own.
    """
    (members,) = fresh(docs, "_members")
    return mixing.draw(docs, mixing.mix(docs.withColumn(members, F.array("source")), members))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences.

    A null or empty text is its end id alone; rows that repeat a doc_id are
    documents of their own. Every stage gives no rows for an empty table and
    leaves columns beside those of documents as they are.
    """
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixture),
    ("packing", packed),
]

#: The fingerprints, the seeded order and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; in between, tables in the shared folder, gone once used."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if k:
                remove(spark, f"{folder}/{STAGES[k - 1][0]}")  # nothing reads it any more
    return docs
