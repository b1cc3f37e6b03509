"""Mixing overlapping sources to target weights by min-cost flow on membership patterns."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import WORD, as_row, components, from_row, sha_of, table, text_of
from tapeloom.storage import cut, numbered

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17

#: Documents of a pattern that are sorted where its last part stops, on average and whatever the corpus.
STOP_DOCS = 128
#: Patterns that are broadcast to the documents at most; more are joined by shuffle.
BROADCAST_PATTERNS = 50_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(slim: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from rows with members (array of sources) and size.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn.
    They share all sizes by weight; a target stops at ``repeats`` times its
    source's size and the excess is shared again until none is above.
    """
    total = slim.agg(F.sum("size")).first()[0] or 0
    sizes = slim.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "rank").drop("_null")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight.cast("double")).withColumn("most", (repeats * F.col("source_size")).cast("double")))
    level, before = 0.0, None
    while True:
        # the words that a unit of weight gets, once the sources at their limit are taken out
        full = F.col("most") <= F.lit(level) * F.col("weight")
        n, held, open_weight = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight or n == before:
            break
        level, before = (total - (held or 0.0)) / open_weight, n
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def min_cost_flow(supply: list[int], members: list[list[int]], quota: dict[int, int], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources.

    A pattern's k-th repetition costs k - 1 a word. All costs lie on the arcs
    into the patterns, so cheapest paths come tier by tier: the flow of one
    repetition is made maximal before the next one opens.
    """
    sent = [dict.fromkeys(m, 0) for m in members]
    missing = dict(quota)
    of: dict[int, list[int]] = {}
    for p, m in enumerate(members):
        for s in m:
            of.setdefault(s, []).append(p)
    spare = [0] * len(supply)
    for _ in range(repeats):
        spare = [x + y for x, y in zip(spare, supply, strict=True)]
        while True:
            # shortest path from a pattern with spare words to a source that misses some
            origin: dict = {("p", p): None for p, x in enumerate(spare) if x > 0}
            queue, end = deque(origin), None
            while queue and end is None:
                kind, i = node = queue.popleft()
                if kind == "s" and missing.get(i, 0) > 0:
                    end = node
                steps = [("s", s) for s in members[i]] if kind == "p" else [("p", p) for p in of[i] if sent[p][i] > 0]
                for step in steps:
                    if step not in origin:
                        origin[step] = node
                        queue.append(step)
            if end is None:
                break
            path = [end]
            while origin[path[-1]] is not None:
                path.append(origin[path[-1]])
            path.reverse()
            amount = min(spare[path[0][1]], missing[end[1]], *(sent[path[k + 1][1]][path[k][1]] for k in range(1, len(path) - 1, 2)))
            for k in range(len(path) - 1):
                p, s, sign = (path[k][1], path[k + 1][1], 1) if path[k][0] == "p" else (path[k + 1][1], path[k][1], -1)
                sent[p][s] += sign * amount
            spare[path[0][1]] -= amount
            missing[end[1]] -= amount
    return sent


def _solved(patterns: DataFrame, repeats: int) -> DataFrame:
    """Add flow (words that the pattern sends); patterns that share sources are solved together.

    One task holds one connected set of sources and patterns: totals only,
    never documents.
    """
    shared = patterns.where(F.size("ranks") > 1)
    parts = patterns.withColumn("part", F.array_min("ranks"))
    if not shared.isEmpty():
        least = F.array_min("ranks")
        edges = shared.select(F.explode("ranks").alias("a"), least.alias("b"))
        roots = components(edges).withColumnRenamed("node", "part")
        parts = parts.join(roots, "part", "left").withColumn("part", F.coalesce("root", "part")).drop("root")

    def solve(part):
        quota = {}
        for ranks, quotas in zip(part["ranks"], part["quotas"], strict=True):
            quota.update({int(r): int(q) for r, q in zip(ranks, quotas, strict=True)})
        part = part.sort_values("pattern").reset_index(drop=True)
        sent = min_cost_flow([int(x) for x in part["supply"]], [[int(r) for r in x] for x in part["ranks"]], quota, repeats)
        return part[["pattern"]].assign(flow=[sum(x.values()) for x in sent])

    flows = parts.select("part", "pattern", "ranks", "quotas", "supply").groupBy("part").applyInPandas(solve, "pattern string, flow long")
    return patterns.join(flows, "pattern")


def member_set(m: Column) -> Column:
    none = F.array(F.lit(None).cast("string"))
    m = F.coalesce(m, none)
    return F.array_sort(F.array_distinct(F.when(F.size(m) == 0, none).otherwise(m)))


def pattern_of(members: str | Column) -> Column:
    return F.to_json(members, {"ignoreNullFields": "false"})


def mix(docs: DataFrame, members: str = "members", weights=WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, members, source_size, target, taken, sha) of every document; sha is that of its text.

    ``docs`` has doc_id, text and ``members``, the array of sources that hold
    the document (an element may be null; an empty or null array counts as the
    null source). A null text has size 0 and gives nothing. source_size and
    target are those of the first member. A pattern's documents are taken
    evenly: all of them ``flow // supply`` times, then, in the order of a
    seeded hash, until the words still needed are reached; the last document
    gives only its first words. Rows that repeat a doc_id are taken one by
    one. An empty table gives no rows.
    """
    slim = docs.select("doc_id", member_set(F.col(members)).alias("members"), size_of(text_of()).alias("size"), sha_of().alias("sha"))
    slim = slim.withColumn("pattern", pattern_of("members")).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    slim = cut(slim)
    targets = cut(source_targets(slim, weights, repeats))
    patterns = slim.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("supply"), F.count("*").alias("n"))
    patterns = cut(patterns)
    each = patterns.select("pattern", F.posexplode("members").alias("pos", "source"))
    t = targets.withColumnRenamed("source", "_source")
    each = each.join(t, F.col("source").eqNullSafe(F.col("_source")))
    of = each.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("pos", "rank", "source_size", "target"))).alias("of"))
    patterns = patterns.join(of, "pattern").select(
        "pattern",
        "supply",
        "n",
        F.transform("of", lambda x: x["rank"]).alias("ranks"),
        F.transform("of", lambda x: F.round(x["target"]).cast("long")).alias("quotas"),
        F.col("of")[0]["source_size"].alias("source_size"),
        F.col("of")[0]["target"].alias("target"),
    )
    plans = cut(_solved(cut(patterns), repeats))
    whole = F.when(F.col("supply") > 0, F.floor(F.col("flow") / F.col("supply"))).otherwise(0).cast("long")
    plans = plans.withColumn("whole", whole).withColumn("rest", F.col("flow") - F.col("whole") * F.col("supply"))
    n_patterns, n = plans.agg(F.count("*"), F.max("n")).first()
    near = F.broadcast if n_patterns <= BROADCAST_PATTERNS else (lambda x: x)
    # where in the seeded order each pattern stops: sums by coarse bucket, in the one that it
    # stops in sums by fine bucket, and one of these is sorted; each has the root of n buckets
    bits = max(0, (n or 0) // STOP_DOCS).bit_length()
    fine = 1 << bits // 2
    place = F.pmod("_h", F.lit(1 << bits).cast("long"))
    slim = slim.withColumns({"coarse": F.floor(place / fine), "fine": place % fine})
    plans = _stops(slim, plans.withColumn("need", F.col("rest")), "coarse")
    inside = slim.join(near(plans.select("pattern", F.col("coarse_stop").alias("coarse"))), ["pattern", "coarse"])
    plans = _stops(inside, plans, "fine").select("pattern", "source_size", "target", "whole", "need", "coarse_stop", "fine_stop")
    rows = slim.join(near(cut(plans)), "pattern")
    here = F.col("coarse").eqNullSafe(F.col("coarse_stop"))
    at_stop = here & F.col("fine").eqNullSafe(F.col("fine_stop"))
    before = (F.col("coarse") < F.col("coarse_stop")) | (here & (F.col("fine") < F.col("fine_stop")))
    sure = rows.where(~at_stop).withColumn("extra", F.when(before, F.col("size")).otherwise(0))
    order = W.partitionBy("pattern").orderBy("_h", "doc_id", "size", "sha").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("need") - F.coalesce(F.sum("size").over(order), F.lit(0))
    stop = rows.where(at_stop).withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least("size", left)))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return sure.unionByName(stop).select("doc_id", "size", "members", "source_size", "target", taken.alias("taken"), "sha")


def _stops(slim: DataFrame, plans: DataFrame, bucket: str) -> DataFrame:
    """``plans`` plus the bucket in which each pattern's ``need`` runs out; need becomes what that bucket gives."""
    sums = slim.groupBy("pattern", bucket).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("pattern").orderBy(bucket))
    sums = sums.withColumn("upto", upto).join(plans.select("pattern", "need"), "pattern")
    stop = sums.where("upto - words < need AND need <= upto").select("pattern", F.col(bucket).alias(f"{bucket}_stop"), (F.col("upto") - F.col("words")).alias("before"))
    plans = plans.join(stop, "pattern", "left")
    return cut(plans.withColumn("need", F.col("need") - F.coalesce("before", F.lit(0))).drop("before"))


def draw(docs: DataFrame, mixed: DataFrame, members: Column | None = None) -> DataFrame:
    """The documents that the mix takes: each as often as it is taken, the last time cut to its words.

    ``mixed`` is the result of :func:`mix`, one row for each row of ``docs``.
    Rows are matched by doc_id, text and members (by default, those of column
    source, if there); rows that repeat all three are taken in turn, each with
    a take of its own. Whole copies keep their text; ids repeat with the copies.
    """
    columns = docs.columns
    if members is None:
        members = F.array("source") if "source" in columns else None
    pattern = F.lit("") if members is None else pattern_of(member_set(members))
    takes = mixed.select(F.col("doc_id").alias("take_id"), F.col("sha").alias("take_sha"), (F.lit("") if members is None else pattern_of("members")).alias("take_of"), "size", "taken")
    takes = cut(takes)
    rows = docs.select(as_row(docs), F.col("doc_id").alias("id"), sha_of().alias("sha"), pattern.alias("of"))
    key, row_key, marks = (["take_id", "take_sha", "take_of"], ["id", "sha", "of"], ["again_id", "again_sha", "again_of"])
    again = cut(takes.groupBy(key).count().where("count > 1").drop("count").toDF(*marks))
    same = lambda x, y: F.col(x[0]).eqNullSafe(F.col(y[0])) & (F.col(x[1]) == F.col(y[1])) & (F.col(x[2]) == F.col(y[2]))
    if again.isEmpty():
        rows = rows.join(takes.where("taken > 0"), same(row_key, key))
    else:
        once = rows.join(again, same(row_key, marks), "left_anti").join(takes.where("taken > 0"), same(row_key, key))
        turn = lambda x, by: x.join(again, same(by, marks), "left_semi").withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.lit(0))))
        own = turn(takes, key).withColumnRenamed("k", "n")
        several = turn(rows, row_key).join(own, same(row_key, key) & (F.col("k") == F.col("n"))).where("taken > 0")
        rows = once.unionByName(several.drop("k", "n"))
    turns = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), turns)))
    left = (F.col("taken") - (F.col("turn") - 1) * F.col("size")).cast("int")
    whole, part = F.col("row.text"), left < F.col("size")
    head = F.array_join(F.slice(F.split(F.btrim(whole, F.lit(" \t\n\x0b\x0c\r")), r"(?=[\x20\x09-\x0D])(?<![\x20\x09-\x0D])"), 1, F.greatest(left, F.lit(1))), "")
    rows = rows.withColumn("given", F.when(part, head).otherwise(whole))
    instead = {"text": F.col("given")}
    if "n_chars" in columns:
        instead["n_chars"] = F.when(part, F.length("given").cast("long")).otherwise(F.col("row.n_chars"))
    return from_row(rows, columns, instead)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("members"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
