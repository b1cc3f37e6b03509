"""Training rows of the learned operators: a bounded, reproducible sample of the labels."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.storage import cut

FOLDS = 5
#: UTF-8 bytes of all training texts together, at most: rows are taken until the next one would not fit.
MAX_TRAIN_BYTES = 128 << 20
#: A text above this part of the bound is not learned from, so that one text cannot take the place of all others.
MAX_TEXT_SHARE = 16


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_texts(docs: DataFrame, labels: DataFrame, target: str, most: int, seed: int = 11, most_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows outside the held-out fold, with whole texts.

    Ids are taken in the order of a seeded hash, as long as their texts fit
    into ``most_bytes`` together, texts above a sixteenth of it left out; only
    ids of ``docs`` count. If no labelled text is left this way a warning says
    so, as what is learned is then the prior alone. Null labels and ids are
    left out; of repeated ids the larger label counts, and the least
    of their texts. So ``most`` and ``most_bytes`` bound the result whatever
    repeats.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    turn = F.xxhash64(F.lit(seed), "doc_id")
    chosen = rows.orderBy(turn, "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
    found = cut(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    # one row of two numbers for each chosen id: a short window
    sizes = found.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).where(F.col("size") <= most_bytes // MAX_TEXT_SHARE)
    upto = F.sum("size").over(W.orderBy(turn, "doc_id"))
    fits = sizes.select("doc_id", upto.alias("bytes")).where(F.col("bytes") <= most_bytes).select("doc_id")
    if fits.isEmpty() and not found.isEmpty():
        warnings.warn(f"no labelled text of {target} is small enough to learn from", stacklevel=2)
    return found.join(F.broadcast(fits), "doc_id")
