"""Near copies by the Jaccard similarity of word shingles.

SimHash fingerprints in a multi-index and MinHash bands find pairs, whole shingle sets decide.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm import simhash
from tapeloom.llm.common import components, keep_one, sha_of, slices
from tapeloom.storage import cut

WIDTH = 5
SEED = 42

#: Two texts are near copies from this similarity on.
SIMILAR = 0.8

#: A pair shares a bucket with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8, more above.
BANDS, ROWS = 24, 5

#: Members of one bucket up to which all pairs are compared; larger ones are compared with this many pivots first.
BUCKET_CAP, PIVOTS = 64, 3
#: Bytes of the pivots' texts that are broadcast at most; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bits that tell which shingles of a pivot a text has not.
LOST_BITS = 256

#: Shingles that are hashed by all functions at a time: bounds the memory of one very long text.
SHINGLES_AT_ONCE = 1 << 12

#: Texts of candidates whose digests are broadcast at most; more are joined by shuffle.
BROADCAST_TEXTS = 1_000_000


def shingles(text: str, width: int = WIDTH):
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    import numpy as np
    from xxhash import xxh64_digest

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    join = b" ".join
    parts = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.frombuffer(b"".join([xxh64_digest(join(s), SEED) for s in parts]), dtype=np.uint64))


@lru_cache(1)
def _factors():
    import numpy as np

    draw = np.random.default_rng(SEED)
    return tuple(draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def bands(found):
    """One bucket key for each band of a set of shingle hashes, the band's number folded in."""
    import numpy as np

    times, plus = _factors()
    least = np.full(len(times), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        part = found[None, at : at + SHINGLES_AT_ONCE]
        np.minimum(least, (part * times[:, None] + plus[:, None]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, node, fp, keys) of every row; node is the digest of the shingle set, 0 without words, fp its SimHash."""
    def scan(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for b in slices(batches):
            nodes, prints, keys = [], [], []
            for t in b.column(2):
                found = shingles(t.as_py())
                nodes.append(xxh64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0)
                prints.append(simhash.majority(found.view("u1").reshape(-1, 8)))
                keys.append(bands(found) if len(found) else [])
            columns = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "sha", "node", "fp", "keys"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha_of().alias("sha"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(scan, "doc_id long, sha binary, node long, fp long, keys array<long>")


def measured(pairs: DataFrame, texts: DataFrame, lost: bool = False, few: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, b) with both, the shingles that the two share, and either, those of either.

    ``lost`` adds which of a's shingles b has not, as set bits: a bit stands
    for all shingles of one remainder, so there are at least as many as bits.
    ``few`` are the texts of all a, if they are few enough to broadcast.
    """

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        last = {}
        for batch in slices(batches):  # few pairs' texts at a time as Python objects
            both, either, masks = [], [], []
            for node, x, y in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if node not in last:
                    last = {node: shingles(x)}
                own, other = last[node], shingles(y)
                common = np.isin(own, other, assume_unique=True)
                n = int(common.sum())
                both.append(n)
                either.append(len(own) + len(other) - n)
                if lost:
                    bits = np.zeros(LOST_BITS, bool)
                    bits[(own[~common] % np.uint64(LOST_BITS)).astype(np.int64)] = True
                    masks.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
            columns = [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64()), *([pa.array(masks, pa.list_(pa.int64()))] if lost else [])]
            yield pa.record_batch(columns, names=["a", "b", "both", "either", *(["lost"] if lost else [])])

    x, y = (texts.select(F.col("node").alias(k), F.col("text").alias(f"{k}_text")) for k in "ab")
    if few is not None:
        x = F.broadcast(few.select(F.col("node").alias("a"), F.col("text").alias("a_text")))
    rows = pairs.join(y, "b").join(x, "a").select("a", "b", "a_text", "b_text")
    return rows.mapInArrow(scan, "a long, b long, both long, either long" + (", lost array<long>" if lost else ""))


def hot_sizes(texts: DataFrame) -> DataFrame:
    """(node, size, own) of each text: its distinct shingles, and those that no other of ``texts`` has."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = shingles(text.as_py())
                yield pa.record_batch([pa.array(np.full(len(found), node, np.int64)), pa.array(found.view(np.int64))], names=["node", "shingle"])

    each = texts.select("node", "text").mapInArrow(scan, "node long, shingle long")
    single = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    return each.groupBy("node").agg(F.count("*").alias("size")).join(single, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))


def indexed(found: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """Pairs (a, b) of shingle sets that the multi-index over their SimHash fingerprints links.

    Each fingerprint is stood for by the smallest set that has it; sets of one
    fingerprint are paired with that set.
    """
    prints = found.where(F.size("keys") > 0).select("node", "fp").distinct()
    heads = cut(prints.groupBy("fp").agg(F.min("node").alias("head")))
    near = F.broadcast if heads.count() <= BROADCAST_TEXTS else (lambda x: x)
    same = prints.join(near(heads), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    edges = simhash.links(heads.select("fp"), cap)
    for side in "ab":
        edges = edges.join(near(heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head"))), side)
    return _pair(same.union(edges.select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))))


def links(docs: DataFrame, found: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """Edges (a, b) between the shingle sets of ``found`` that the index links or that share a bucket, and that are similar enough.

    A bucket with more than ``cap`` members is not compared pair by pair: see
    :func:`_hot_links`.
    """
    each = found.select("node", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("_last")).where("head <> _last").select("key")
    members = cut(each.join(shared, "key").select("key", "node").distinct())
    hot = cut(members.groupBy("key").count().where(F.col("count") > cap).select("key"))
    small, large = members.join(hot, "key", "left_anti"), members.join(hot, "key", "left_semi")
    banded = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b")
    pairs = cut(_pair(banded.select("a", "b").union(indexed(found, cap))))
    # one text of each candidate
    wanted = members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    reps = cut(found.select("node", "sha").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("sha").alias("sha")))
    near = F.broadcast if reps.count() <= BROADCAST_TEXTS else (lambda x: x)
    texts = docs.select(sha_of().alias("sha"), "text").join(near(reps), "sha").select("node", "text")
    texts = cut(texts.groupBy("node").agg(F.min("text").alias("text")))
    edges = measured(pairs, texts).where(IS_SIMILAR).select("a", "b")
    return edges if hot.isEmpty() else edges.union(_hot_links(cut(large), texts, pairs))


IS_SIMILAR = f"both >= {SIMILAR} * either"


def _pair(x: DataFrame) -> DataFrame:
    return x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hot_links(large: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """Edges inside the large buckets (key, node), but for those among ``known`` pairs that join no other groups.

    The members of a bucket are compared with its ``PIVOTS`` members that have
    the smallest share of shingles of their own: in a group of edited copies
    these are nearest to the original, so nearly all that is linked at all is
    linked through them. Only members outside the bucket's largest group are
    compared further, and only with members that can still be similar:

    * shingles of one's own are in no other set, so of sets with s shared and
      u own shingles at most min(s, s') are common and at least
      u + u' + max(s, s') are in either;
    * what either has lost of the first pivot's shingles they cannot share, and
      of the rest at most what the poorer one has;
    * 1 - similarity is a metric, so two sets whose distances from a pivot
      differ by more than the radius are too far from each other.

    All tests are exact: no pair at the threshold is lost.
    """
    sizes = hot_sizes(texts.join(large.select("node").distinct(), "node", "left_semi"))
    large = cut(large.join(sizes, "node"))
    first = W.partitionBy("key").orderBy(F.col("own") / F.col("size"), "node")
    pivots = large.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PIVOTS).select("key", "rank", F.col("node").alias("pivot"), F.col("size").alias("pivot_size"))
    pivots = cut(pivots)
    near = F.broadcast if pivots.count() <= BROADCAST_TEXTS else (lambda x: x)
    spokes = large.join(near(pivots), "key").where("node <> pivot")
    few = cut(texts.join(pivots.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi"))
    size = few.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tried = measured(spokes.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), texts, lost=True, few=few if size <= BROADCAST_BYTES else None)
    tried = cut(tried)
    edges = tried.where(IS_SIMILAR).select("a", "b")
    far = (1 - F.col("both") / F.col("either")).alias("far")
    legs = spokes.join(tried.select(F.col("a").alias("pivot"), F.col("b").alias("node"), far, "both", "lost", F.expr(IS_SIMILAR).alias("linked")), ["pivot", "node"])
    legs = cut(legs.select("key", "node", "rank", "pivot", "far", "both", "lost", "linked"))
    # the largest group: all that the first pivot, or a pivot linked to it, is linked to
    inside = legs.where("rank = 1 AND linked").select("key", F.col("node").alias("pivot")).join(near(pivots), ["key", "pivot"], "left_semi").withColumn("inside", F.lit(True))
    placed = legs.join(near(inside), ["key", "pivot"], "left").groupBy("key", "node").agg(
        F.sort_array(F.collect_list(F.struct("rank", "far"))).alias("far"),  # at most PIVOTS
        F.max(F.when(F.col("rank") == 1, F.struct("both", "lost"))).alias("first"),
        F.bool_or(F.col("linked") & ((F.col("rank") == 1) | F.coalesce("inside", F.lit(False)))).alias("main"),
    )
    placed = large.join(near(pivots.where("rank = 1").select("key", "pivot_size")), "key").join(placed, ["key", "node"], "left")
    none = F.array_repeat(F.lit(0).cast("long"), LOST_BITS // 64)
    is_first = F.col("first").isNull()  # every other member has a distance from the first pivot
    placed = placed.select(
        "key", "node", (is_first | F.coalesce("main", F.lit(False))).alias("main"), "size", "own", "far", "pivot_size",
        F.coalesce("first.lost", none).alias("lost"),  # the first pivot itself has lost nothing
        F.when(is_first, 0).otherwise(F.col("size") - F.col("own") - F.col("first.both")).alias("beside"),
    )
    placed = cut(placed)
    rest = placed.where("NOT main").where(F.col("size") - F.col("own") + 1e-9 >= SIMILAR * F.col("size"))
    rest = rest.select("key", *[F.col(c).alias(f"{c}_") for c in ("node", "size", "own", "far", "lost", "beside")])
    s, s_ = F.col("size") - F.col("own"), F.col("size_") - F.col("own_")
    may = F.least(s, s_) + 1e-9 >= SIMILAR * (F.col("own") + F.col("own_") + F.greatest(s, s_))
    gone = sum((F.bit_count(F.col("lost")[k].bitwiseOR(F.col("lost_")[k])) for k in range(LOST_BITS // 64)), F.lit(0))
    most = F.col("pivot_size") - gone + F.least("beside", "beside_")
    may = may & (most + 1e-9 >= SIMILAR * (F.col("size") + F.col("size_") - most))
    # a pivot has no distance from itself in its list; lists of others match rank by rank
    apart = F.exists(F.arrays_zip("far", "far_"), lambda z: (z["far"]["rank"] == z["far_"]["rank"]) & (F.abs(z["far"]["far"] - z["far_"]["far"]) > 1 - SIMILAR + 1e-9))
    more = rest.join(placed, "key").where((F.col("node") != F.col("node_")) & may & ~F.coalesce(apart, F.lit(False)))
    more = _pair(more.select(F.col("node").alias("a"), F.col("node_").alias("b")))
    more = cut(more.join(known.union(_pair(tried.select("a", "b"))), ["a", "b"], "left_anti"))
    return edges.union(measured(more, texts).where(IS_SIMILAR).select("a", "b"))


def near_copies(docs: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """(doc_id, sha, component) of every row: equal components are linked by pairs of near copies."""
    found = cut(signatures(docs))
    roots = components(cut(links(docs, found, cap)))
    return found.join(roots, "node", "left").select("doc_id", "sha", F.coalesce("root", "node").alias("component"))


def drop_near_copies(docs: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies, that with the smallest doc_id.

    Null and empty texts are one group. Groups are told apart by row, so rows
    that repeat a doc_id are decided each for itself; a null doc_id stays only
    where its group has no other. An empty table gives an empty result.
    """
    return keep_one(docs, cut(near_copies(docs, cap)))
