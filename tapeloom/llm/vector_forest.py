"""Near copies of embeddings: a forest of random splits, comparison within leaves, union of what is linked."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import components, table
from tapeloom.llm.whitening import finite, usual_length
from tapeloom.storage import cut

SIMILAR = 0.9
SEED = 42

#: Vectors of a leaf, roughly. Leaves above twice as many are split again; dense ones are compared in blocks of this size.
LEAF = 1024
#: Trees at least; more for tables so large that a path has more than TREES / 2 splits.
TREES = 8
#: The trees are fitted on this many distinct vectors at most, and on so many bytes of them; all vectors are then routed.
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
#: Vectors of a node that its splits are tried on, directions tried, and where on a direction a split may lie.
TRIED, DIRECTIONS, QUANTILES = 768, 8, (0.5, 0.42, 0.58, 0.34, 0.66)
#: A node is dense, and stays whole, if so many of its pairs are links not yet kept and every split would part so many of these.
DENSE_LINKS, DENSE_LOSS = 0.1, 0.2
#: A sampled node below this is not split further on the sample.
LEAST_SAMPLED = 16
#: Vectors that a leaf's own tree is fitted on, roughly, and members of a leaf that one task routes.
LEAF_SAMPLE, ROUTED_AT_ONCE = 2048, 20_000
#: Linked pairs whose leaves are compared at a time.
PAIRS_AT_ONCE = 1 << 18


@dataclass
class Tree:
    """Splits in parallel lists; a child below 0 is the leaf -1 - child."""

    directions: list = field(default_factory=list)
    at: list = field(default_factory=list)
    children: list = field(default_factory=list)
    root: int = 0


def _descend(tree: Tree, units, rows, start: int, leaf, nearest=None, turn=None) -> None:
    """Write into ``leaf`` where ``rows`` end when they start at ``start``; also the split each lies nearest to, if asked."""
    import numpy as np

    todo = [(start, rows)]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node < 0:
            leaf[own] = -1 - node
            continue
        side = units[own] @ tree.directions[node] - tree.at[node]
        if nearest is not None:
            closer = np.abs(side) < nearest[own]
            nearest[own[closer]] = np.abs(side[closer])
            turn[own[closer]] = 2 * node + (side[closer] < 0)  # the child on the other side
        todo += [(tree.children[node][0], own[side < 0]), (tree.children[node][1], own[side >= 0])]


def routed(trees: list[Tree], units, spill: float):
    """Two leaves of each tree for every vector, in columns 2t and 2t + 1.

    The first is where its path ends. A vector within ``spill`` of a split
    overlaps: its second leaf is where it ends if it takes the other side of
    the nearest split on its path. Without such a split both are the same.
    """
    import numpy as np

    n, everything = len(units), np.arange(len(units))
    out = np.zeros((n, 2 * len(trees)), np.int64)
    for t, tree in enumerate(trees):
        leaf, nearest, turn = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -1)
        _descend(tree, units, everything, tree.root, leaf, nearest, turn)
        other = leaf.copy()
        near = nearest <= spill
        for way in np.unique(turn[near]):
            rows = np.flatnonzero(near & (turn == way))
            _descend(tree, units, rows, tree.children[way // 2][1 if way % 2 else 0], other)
        out[:, 2 * t], out[:, 2 * t + 1] = leaf, other
    return out


def _shared(x, y):
    """Whether two rows of (leaf, second leaf) have a leaf in common."""
    return ((x[:, :, None] == y[:, None, :]).any(axis=2)).any(axis=1)


def grow(units, count: int, trees: int, similar: float, leaf: int, spill: float, seed: int = SEED) -> tuple[list[Tree], set[int]]:
    """(trees, dense leaves) fitted on the sample ``units`` of ``count`` vectors.

    A node is split across a random direction. Of some directions and places
    near the median that one is taken that parts fewest of the links seen in
    the node, not counting those that an earlier tree has in one leaf: so a
    tree mends what the trees before it have parted. A node of which links fill
    a good part and that no split leaves whole is a dense leaf; it is compared
    in full at a cost in proportion to the links found.
    """
    import numpy as np

    draw = np.random.default_rng(seed)
    n, d = units.shape
    small = max(LEAST_SAMPLED, leaf * n / max(count, 1))
    forest, dense, names = [], set(), 0
    placed = np.zeros((n, 0), np.int64)
    for t in range(trees):
        tree = Tree()

        def settle(own, tree=tree):
            """The child for ``own``: a leaf or a new split."""
            nonlocal names
            if len(own) > small:
                part = own if len(own) <= TRIED else draw.choice(own, TRIED, replace=False)
                x = units[part]
                a, b = np.nonzero(np.triu(x @ x.T >= similar, 1))
                pairs = len(a)
                if pairs:
                    lost = np.ones(pairs, bool)
                    for k in range(t):
                        lost &= ~_shared(placed[part[a], 2 * k : 2 * k + 2], placed[part[b], 2 * k : 2 * k + 2])
                    a, b = a[lost], b[lost]
                directions = draw.normal(size=(DIRECTIONS if len(a) else 1, d))
                directions /= np.linalg.norm(directions, axis=1)[:, None]
                best = None
                for direction in directions:
                    at = x @ direction
                    for q in QUANTILES if len(a) else QUANTILES[:1]:
                        place = np.quantile(at, q)
                        loss = float(((at[a] < place) != (at[b] < place)).mean()) if len(a) else 0.0
                        if best is None or loss + 0.1 * abs(q - 0.5) < best[0]:
                            best = (loss + 0.1 * abs(q - 0.5), loss, direction, place)
                _, loss, direction, place = best
                is_dense = len(a) >= DENSE_LINKS * len(part) * (len(part) - 1) / 2 and loss > DENSE_LOSS
                side = units[own] @ direction < place
                if not is_dense and 0 < side.sum() < len(own):
                    tree.directions.append(direction)
                    tree.at.append(place)
                    tree.children.append(None)
                    return len(tree.at) - 1, (own[side], own[~side])
                if is_dense:
                    dense.add(names)
            names += 1
            return -names, None

        tree.root, parts = settle(np.arange(n))
        todo = [(tree.root, parts)] if parts else []
        while todo:
            node, halves = todo.pop()
            below = [settle(own) for own in halves]
            tree.children[node] = (below[0][0], below[1][0])
            todo += [x for x in below if x[1]]
        forest.append(tree)
        placed = np.hstack([placed, routed([tree], units, spill)])
    return forest, dense


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, digest, unit) of every row: the vector of length 1 as bytes of doubles and a digest of the entries; both null if it links with nothing."""
    d = usual_length(embeddings.select("embedding").where(finite()), "embedding")

    def scan(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            digests, units = [], []
            for v in b.column(1):
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
                if x is None or not x.any():
                    digests.append(None)
                    units.append(None)
                    continue
                digests.append(hashlib.sha256(x.tobytes()).digest())
                x = x / np.abs(x).max()  # no square runs over or under
                units.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.record_batch([b.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "digest", "unit"])

    good = F.when(finite() & (F.size("embedding") == d), F.col("embedding").cast("array<double>"))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), good.alias("v")).mapInArrow(scan, "vec_id long, digest binary, unit binary")


def _units(column):
    import numpy as np

    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), float).reshape(len(rows), -1)


def _in_leaves(classes: DataFrame, similar: float, leaf: int, trees: int, sample: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, copies, unit, leaves) of every distinct vector, and the leaves that are compared in blocks as (leaf, blocks)."""
    spark, count = classes.sparkSession, classes.count()
    d = len(classes.select("unit").first().unit) // 8
    sample = max(2, min(sample, SAMPLE_BYTES // (8 * d)))
    chosen = classes.orderBy(F.xxhash64("digest"), "digest").limit(sample).select("unit").toArrow()
    trees = max(trees, 2 * math.ceil(math.log2(max(2, count / leaf))))
    spill = math.sqrt(2 - 2 * similar) / math.sqrt(d) / 2  # half of what two linked vectors differ by on a direction
    forest, dense = grow(_units(chosen["unit"].combine_chunks()), count, trees, similar, leaf, spill)
    shared = spark.sparkContext.broadcast((forest, spill))

    def route(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                leaves = routed(shared.value[0], _units(b.column(2)), shared.value[1])
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(list(leaves), pa.list_(pa.int64()))], names=["node", "copies", "unit", "leaves"])

    placed = cut(classes.select("node", "copies", "unit").mapInArrow(route, "node long, copies long, unit binary, leaves array<long>"))
    sizes = placed.select(F.explode(F.array_distinct("leaves")).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf)
    wide = cut(sizes.withColumn("dense", F.col("leaf").isin(sorted(dense))))
    loose, blocks = wide.where("NOT dense").select("leaf", "n"), wide.where("dense").select("leaf", "n")
    depth, where = 0, None
    while not loose.isEmpty():
        # leaves too large for the sample to have split them: a tree of their own, fitted on a sample of each
        if where is None:
            where = placed.select("node", F.posexplode("leaves").alias("slot", "leaf"))
        moved = _split_again(where.join(loose, "leaf").join(placed.select("node", "unit"), "node"), similar, leaf, depth)
        where = cut(where.join(moved, ["node", "slot"], "left").select("node", "slot", F.coalesce("half", "leaf").alias("leaf")))
        sizes = where.select("node", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf)
        whole = loose.select("leaf").union(blocks.select("leaf"))  # dense ones, or such as no split divides
        sizes = cut(sizes)
        loose, blocks, depth = cut(sizes.join(whole, "leaf", "left_anti")), cut(sizes.join(whole, "leaf", "left_semi")), depth + 1
    if where is not None:
        leaves = F.transform(F.sort_array(F.collect_list(F.struct("slot", "leaf"))), lambda x: x["leaf"])  # two for each tree
        placed = cut(placed.drop("leaves").join(where.groupBy("node").agg(leaves.alias("leaves")), "node"))
    blocks = None if blocks.isEmpty() else blocks.select("leaf", F.ceil(F.col("n") / leaf).cast("int").alias("blocks"))
    return placed, blocks


def _split_again(members: DataFrame, similar: float, leaf: int, depth: int) -> DataFrame:
    """(node, slot, half): the new leaf of each of ``members`` (node, slot, leaf, n, unit); the old one where nothing splits it."""

    def fit(rows):
        import pickle

        import pyarrow as pa

        name, units = rows["leaf"][0].as_py(), _units(rows["unit"].combine_chunks())
        spread = math.sqrt(2 - 2 * similar) / math.sqrt(units.shape[1]) / 2
        forest, _ = grow(units, rows["n"][0].as_py(), 1, similar, leaf, spread, [SEED, depth, name & 0xFFFFFFFF])
        return pa.table({"leaf": [name], "tree": [pickle.dumps(forest[0])]})

    def route(rows, fitted):
        import pickle

        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        if not len(rows) or not len(fitted):
            halves = rows["leaf"]
        else:
            tree, name = pickle.loads(fitted["tree"][0].as_py()), rows["leaf"][0].as_py()
            found = routed([tree], _units(rows["unit"].combine_chunks()), -1.0)[:, 0]
            names = [xxh64_intdigest(f"{name} {depth} {k}") - (1 << 63) for k in range(len(tree.at) + 1)] if tree.at else [name]
            halves = pa.array(np.array(names, np.int64)[found])
        return pa.table({"node": rows["node"], "slot": rows["slot"], "half": halves})

    members = cut(members.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / ROUTED_AT_ONCE))))
    seen = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(1 << 30)) < F.lit(LEAF_SAMPLE << 30) / F.col("n")
    trees = cut(members.where(seen).select("leaf", "n", "unit").groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"))
    trees = trees.join(members.select("leaf", F.col("part").alias("own")).distinct(), "leaf")  # a tree for each part
    return members.groupBy("leaf", "part").cogroup(trees.groupBy("leaf", "own")).applyInArrow(route, "node long, slot int, half long")


def compared(members: DataFrame, similar: float) -> DataFrame:
    """(node, root, links): for each group of ``members``, how many vectors each links with, copies counted, and a node that links lead to.

    ``members`` has group columns leaf, lo and hi, and slot, block, node,
    copies, unit and leaves. Where lo and hi differ, only vectors of different
    blocks are compared. A pair that has an earlier leaf in common is left to
    that leaf, so no pair counts twice and no pair leaves the task.
    """

    def compare(rows):
        import numpy as np
        import pyarrow as pa

        nodes, copies, units = rows["node"].to_numpy(), rows["copies"].to_numpy(), _units(rows["unit"].combine_chunks())
        leaf, block, tree = rows["leaf"][0].as_py(), rows["block"].to_numpy(), rows["slot"].to_numpy()
        leaves = np.array(rows["leaves"].to_pylist(), np.int64).reshape(len(nodes), -1)
        linked = units @ units.T >= similar
        linked &= np.tri(len(nodes), dtype=bool, k=-1).T
        if rows["lo"][0].as_py() != rows["hi"][0].as_py():
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        tree = int(tree.min()) // 2
        for at in range(0, len(a), PAIRS_AT_ONCE):
            x, y = a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]
            before = np.zeros(len(x), bool)
            for k in range(tree):
                before |= _shared(leaves[x, 2 * k : 2 * k + 2], leaves[y, 2 * k : 2 * k + 2])
            p, q = leaves[x, 2 * tree : 2 * tree + 2], leaves[y, 2 * tree : 2 * tree + 2]
            both = np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p, np.iinfo(np.int64).max)
            before |= both.min(axis=1) != leaf
            linked[x[before], y[before]] = False
        linked |= linked.T
        links = linked @ copies
        root, seen = np.arange(len(nodes)), links == 0
        for first in range(len(nodes)):
            if seen[first]:
                continue
            seen[first], front = True, np.array([first])
            while len(front):
                new = linked[front].any(axis=0) & ~seen
                seen |= new
                root[new] = first
                front = np.flatnonzero(new)
        found = np.flatnonzero(links)
        return pa.table({"node": nodes[found], "root": nodes[root[found]], "links": links[found].astype(np.int64)})

    return members.groupBy("leaf", "lo", "hi").applyInArrow(compare, "node long, root long, links long")


def near_vectors(embeddings: DataFrame, similar: float = SIMILAR, leaf: int = LEAF, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Needs columns vec_id and embedding; others are ignored. Two vectors link
    if they share a leaf of some tree and their cosine in double precision is
    ``similar`` or more. Vectors that are null, empty, zero, hold nulls, NaN or
    infinities, or have another length than the most frequent one link with
    nothing. Equal vectors are one class, compared once, and link with each
    other; rows that repeat a vec_id count each. A null vec_id takes part and
    is the id only of a component without another. An empty table gives no rows.

    The forest is fitted on a bounded sample, seeded and in a fixed order; all
    vectors are routed and compared. A row goes to at most two leaves of a tree.
    """
    rows = cut(unit_vectors(embeddings))
    good = rows.where("digest IS NOT NULL")
    classes = good.groupBy("digest").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if classes.isEmpty():
        return _with_kept(alone)
    placed, blocks = _in_leaves(classes, similar, leaf, trees, sample)
    members = placed.select("node", "copies", "unit", "leaves", F.posexplode("leaves").alias("slot", "leaf"))
    # a second leaf that is the first again says nothing
    members = members.where((F.col("slot") % 2 == 0) | (F.col("leaf") != F.element_at("leaves", F.col("slot").cast("int"))))
    block = F.lit(0)
    if blocks is None:
        members = members.select("*", block.alias("block"), block.alias("lo"), block.alias("hi"))
    else:
        members = members.join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("blocks", "other")
    found = cut(compared(members, similar))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("digest", "copies", "least", "node").join(counts, "node", "left").join(roots, "node", "left")
    named = named.select("digest", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = cut(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(named.join(ids, "root").select("digest", "n_links", "component_id"))
    return _with_kept(good.select("vec_id", "digest").join(named, "digest").select("vec_id", "n_links", "component_id").unionByName(alone))


def _with_kept(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
