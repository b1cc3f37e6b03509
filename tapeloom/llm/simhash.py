"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import components, keep_one, sha_of, slices, table
from tapeloom.storage import cut

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2

#: Fingerprints in one bucket up to which its pairs are compared; larger buckets take the ball path.
BUCKET_CAP = 64

#: Hashes whose bits are counted at a time: bounds the memory of one very long text.
BITS_AT_ONCE = 1 << 16


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: bit i is set if it is set in over half of the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_digest

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    join = b" ".join
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    digests = b"".join([xxh64_digest(join(s), SEED) for s in shingles])
    return majority(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8))


def majority(digests) -> int:
    """The bits that over half of the eight-byte digests have set."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), BITS_AT_ONCE):
        ones += np.unpackbits(digests[at : at + BITS_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(digests)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, fp) of every row; null texts have no words and fingerprint zero."""
    def scan(batches):
        import pyarrow as pa

        for b in slices(batches):
            fps = [fingerprint(t.as_py() or "") for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "sha", "fp"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha_of().alias("sha"), "text")
    return ids.mapInArrow(scan, "doc_id long, sha binary, fp long")


def _high(x: Column) -> Column:
    return F.shiftright(x, 32)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def links(prints: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within two bits; ``prints`` has distinct fp.

    The two halves are indexed. Two fingerprints within two bits agree in the
    low half, or differ by at most one bit in the high half. So each is stored
    under both halves and asks for its low half, its high half, and the high
    halves one bit away; as one of two such neighbours has an even number of
    bits in its high half, only those ask. Matches are verified on all 64 bits.

    A bucket with more than ``cap`` fingerprints is not compared pair by pair.
    All that are stored in it or ask for it go to the ball path: each emits the
    65 values within one bit of itself, and all that emit the same value are
    linked to the smallest of them. Two fingerprints within two bits share such
    a value, and two that share one are within two bits, so this is exact.
    """
    fp = F.col("fp")
    stored = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), _high(fp).alias("value")), F.struct(F.lit(1).alias("half"), _low(fp).alias("value")))).alias("k"))
    stored = stored.select("fp", "k.half", "k.value")
    own = F.array(F.struct(F.lit(0).alias("half"), _high(fp).alias("value")), F.struct(F.lit(1).alias("half"), _low(fp).alias("value")))
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.struct(F.lit(0).alias("half"), _high(fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i + 32))).alias("value")),
    )
    even = F.bit_count(_high(fp).bitwiseAND(F.lit(0xFFFFFFFF))) % 2 == 0
    asked = prints.select("fp", F.explode(F.when(even, F.concat(own, flips)).otherwise(own)).alias("k")).select(F.col("fp").alias("asker"), "k.half", "k.value")
    key = ["half", "value"]
    hot = cut(stored.groupBy(key).count().where(F.col("count") > cap).select(key))
    ball_edges = None
    if not hot.isEmpty():
        crowd = stored.join(hot, key, "left_semi").select("fp").union(asked.join(hot, key, "left_semi").select("asker")).distinct()
        stored, asked = stored.join(hot, key, "left_anti"), asked.join(hot, key, "left_anti")
        flips64 = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        balls = crowd.select("fp", F.explode(F.concat(F.array(fp), flips64)).alias("z"))
        heads = balls.groupBy("z").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
        ball_edges = balls.join(heads, "z").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    pairs = asked.join(stored, key).where((F.col("asker") != F.col("fp")) & _near("asker", "fp"))
    edges = pairs.select(F.col("asker").alias("a"), F.col("fp").alias("b"))
    return edges.unionByName(ball_edges) if ball_edges is not None else edges


def near_groups(docs: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    Copies share a fingerprint and are never paired: links run between
    distinct fingerprints. Texts without words have fingerprint zero and link
    like any other. A group's id is its smallest doc_id; null doc_ids take
    part and are the id only of a group that has no other. Repeated rows give
    repeated results, an empty table an empty one.
    """
    found, known = _rooted(docs, cap)
    ids = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(ids, "root").select("fp", "component_id")
    return found.select("doc_id", "fp").join(named, "fp")


def _rooted(docs: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of every row, and (fp, first doc_id, root of its group)."""
    found = cut(fingerprints(docs))
    firsts = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), cap))
    return found, firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, that with the smallest doc_id.

    Each row is decided for itself, also where rows repeat a doc_id; a null
    doc_id stays only where its group has no other.
    """
    found, roots = _rooted(docs, BUCKET_CAP)
    return keep_one(docs, cut(found.join(roots, "fp").select("doc_id", "sha", F.col("root").alias("component"))))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
