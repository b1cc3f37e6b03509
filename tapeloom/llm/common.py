"""Shared pieces of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.storage import cut

#: A word, and what stands between words, as Java/RE2 patterns: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch that a scan of whole texts holds as Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches):
    """The same rows in smaller batches.

    Spark itself bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch);
    slices share its memory, so results go out before the next rows come in.
    """
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def sha_of(column: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(column), 256))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores in front where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def every(df: DataFrame) -> list[Column]:
    """All columns of ``df``, also those with dots or backticks in their names."""
    quoted = [c.replace("`", "``") for c in df.columns]
    return [F.col(f"`{c}`") for c in quoted]


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one column ``row``: whatever their names are, none clashes with a column beside it."""
    return F.struct(*every(df)).alias("row")


def from_row(df: DataFrame, columns: list[str], instead: dict[str, Column] | None = None) -> DataFrame:
    """The columns of the input again, some of them replaced by those of ``instead``."""
    instead = instead or {}
    return df.select(*[instead.get(c, F.col("row").getField(c)).alias(c) for c in columns])


#: Marks of rows that are broadcast at most; more are joined by shuffle.
BROADCAST_MARKS = 1_000_000


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``groups``: that with the smallest doc_id, nulls last.

    ``groups`` has doc_id, sha (of the text) and component of every row; rows
    with one text are in one component. Among rows of one doc_id the smallest
    digest stays; rows that repeat both cannot be told apart, one of them stays.
    """
    keys = groups.groupBy("component", "doc_id", "sha").agg(F.count("*").alias("n"))
    first = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    keys = keys.join(first, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    marks = cut(keys.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("mark_id"), F.col("sha").alias("mark_sha"), stays.alias("again")))
    near = F.broadcast if marks.count() <= BROADCAST_MARKS else (lambda x: x)
    rows = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("id"), sha_of().alias("sha"))
    same = F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("sha") == F.col("mark_sha"))
    rest = rows.join(near(marks), same, "left_anti")
    again = marks.where("again")
    if not again.isEmpty():
        rest = rest.unionByName(rows.join(near(again), same, "left_semi").dropDuplicates(["id", "sha"]))
    return from_row(rest, docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has a link, as (node, root).

    ``edges`` has long columns (a, b). Alternates large-star and small-star
    rounds until the edge set is a forest of stars, in about log(n) rounds.
    Every round is joins and partial aggregates on the edge table, and each
    round is checkpointed. The joins take a hub's edges to one key; adaptive
    execution splits such a partition, as no step collects them in a group.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, before = cut(pair), None
    while True:
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = stars.union(stars.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        stars = cut(small)
