"""Exact de-duplication with a log-structured merge index over text digests."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import as_row, from_row, table, text_of
from tapeloom.storage import cut, remove, shared_dir

#: Hits whose digests go to every executor at most (some 50 bytes each); more are joined by shuffle.
FILTER_MAX_HITS = 200_000
#: Keys of a 64-bit block of a run's filter; blocks that go to every executor at most (16 bytes each).
KEYS_PER_BLOCK, FILTER_MAX_BLOCKS = 6, 1_000_000
#: Batches that a table is put into the index in.
BATCHES = 3


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/merge-index-{uuid.uuid4().hex}"


def _mask(h: Column) -> Column:
    """Four of 64 bits, by a digest's hash."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


@dataclass
class Run:
    """Sorted rows (digest, keep_id, copies), one for each digest, and their blocked Bloom filter (block, bits)."""

    path: str
    rows: int
    blocks: int


class MergeIndex:
    """A log-structured index of digests: sorted runs by level, each with a Bloom filter.

    A batch is a memtable: one identifier and one count for each digest. Before
    it is flushed as a run of level 0, the filters of all runs are asked; only
    rows that a filter may have are joined with that run. Once a level has
    ``fanout`` runs they are merged into one of the next level, so there are
    about as many runs as the logarithm of the batches. Runs are Parquet files
    in ``folder``, which all executors share, sorted by digest within each file.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: str = "min", fanout: int = 2, filters: bool = True):
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.spark, self.folder, self.fanout, self.filters = spark, folder, fanout, filters
        self.pick = F.min if keep == "min" else F.max
        self.levels: list[list[Run]] = []
        #: Rows of batches that were joined with a run, and those that could have been.
        self.asked = self.askable = 0

    def _store(self, table: DataFrame, level: int) -> Run:
        path = f"{self.folder}/level-{level}-{uuid.uuid4().hex}"
        options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        table.sortWithinPartitions("digest").write.options(**options).parquet(f"{path}/rows")
        stored = self.spark.read.parquet(f"{path}/rows")
        rows = stored.count()
        blocks = max(1, rows // KEYS_PER_BLOCK)
        h = F.xxhash64("digest")
        bits = stored.select(F.pmod(F.shiftright(h, 24), F.lit(blocks)).alias("block"), _mask(h).alias("mask"))
        bits.groupBy("block").agg(F.bit_or("mask").alias("bits")).write.parquet(f"{path}/filter")
        return Run(path, rows, blocks)

    def _read(self, run: Run) -> DataFrame:
        return self.spark.read.parquet(f"{run.path}/rows")

    def _possible(self, table: DataFrame, run: Run) -> DataFrame:
        """The rows of ``table`` whose digests the run's filter may have."""
        if not self.filters:
            return table
        bits = self.spark.read.parquet(f"{run.path}/filter")
        near = F.broadcast if run.blocks <= FILTER_MAX_BLOCKS else (lambda x: x)
        h = F.xxhash64("digest")
        asks = table.withColumn("block", F.pmod(F.shiftright(h, 24), F.lit(run.blocks))).join(near(bits), "block")
        return asks.where(F.col("bits").bitwiseAND(_mask(h)) == _mask(h)).drop("block", "bits")

    def _memtable(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy("digest").agg(self.pick("id").alias("keep_id"), F.count("*").alias("copies"))

    def insert(self, entries: DataFrame) -> DataFrame:
        """Add a batch (digest, id); returns the digests of it that it repeats or that an earlier batch has."""
        table = cut(self._memtable(entries))
        hits, size = table.where("copies > 1").select("digest"), table.count()
        for run in (r for level in self.levels for r in level):
            maybe = cut(self._possible(table, run))
            self.asked, self.askable = self.asked + maybe.count(), self.askable + size
            hits = hits.union(maybe.join(self._read(run).select("digest"), "digest", "left_semi").select("digest"))
        hits = cut(hits.distinct())
        self._add(table, 0)
        return hits

    def flush(self, entries: DataFrame) -> None:
        """Add a batch without asking for hits."""
        self._add(self._memtable(entries), 0)

    def _add(self, table: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._store(table, level))
        if len(self.levels[level]) >= self.fanout:
            self._merge(self.levels[level], level + 1)

    def _merged(self, runs: list[Run]) -> DataFrame:
        rows = self._read(runs[0])
        for run in runs[1:]:
            rows = rows.unionByName(self._read(run))
        return rows.groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))

    def _merge(self, runs: list[Run], level: int) -> None:
        """Replace ``runs`` (a level's list) by one run of ``level``."""
        old = list(runs)
        table = self._merged(old)
        runs.clear()
        self._add(table, level)
        for run in old:  # the new run is stored
            remove(self.spark, run.path)

    def compact(self) -> DataFrame:
        """Merge all runs into one; returns (digest, keep_id, copies)."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            top = len(self.levels)
            self.levels = [[] for _ in range(top)]
            self._add(self._merged(runs), top)
            for run in runs:
                remove(self.spark, run.path)
        return self._read(next(r for level in self.levels for r in level))

    def found(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, copies) of the given digests, from all runs."""
        runs = [r for level in self.levels for r in level]
        near = F.broadcast if digests.count() <= FILTER_MAX_HITS else (lambda x: x)
        rows = None
        for run in runs:
            mine = self._read(run).join(near(digests), "digest", "left_semi")
            rows = mine if rows is None else rows.unionByName(mine)
        return rows.groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """The entries of a few digests; needs a call of ``compact`` before. Ranges and filters of the files skip the others."""
        return self._read(next(r for level in self.levels for r in level)).where(F.col("digest").isin(*map(F.lit, digests)))


def exact_groups(docs: DataFrame, keep: str = "max", digest=digest_of, folder: str | None = None, batches: int = BATCHES) -> DataFrame:
    """Group identical texts; returns doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Needs columns doc_id and text. A null text counts as empty, a null doc_id
    never wins against a number, and an empty table gives an empty result.
    Rows that repeat both doc_id and text stay in one group and cannot be told
    apart: if theirs is the id that stays, each of them is marked as kept.
    Other columns are ignored. The result reads digests that lie in ``folder``
    (by default a new one in the shared folder).

    The digests go into a merge index in ``batches`` batches. What a batch
    repeats, or shares with an earlier one as the runs' filters and then the
    runs say, are hits: their texts are compared byte for byte with the text of
    the row that stays. Texts that differ in spite of equal digests are grouped
    by their whole text instead. All others are single.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark)
    sha = F.sha2(text_of(), 256)
    slim = docs.select(F.col("doc_id").alias("id"), digest(text_of()).alias("digest"), F.unhex(sha).alias("sha"))
    slim.withColumn("batch", F.pmod(F.xxhash64("id", "sha"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(f"{folder}/digests")
    slim = spark.read.schema(f"id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, sha binary, batch int").parquet(f"{folder}/digests")
    index, hits = MergeIndex(spark, folder, keep), None
    for k in range(batches):
        new = index.insert(slim.where(F.col("batch") == k).select("digest", "id"))
        hits = new if hits is None else hits.union(new)
    hits = cut(index.found(cut(hits.distinct())))
    n_hits = hits.count()
    slim = slim.select(F.col("id").alias("doc_id"), "digest", "sha")
    if not n_hits:
        return _verdicts(slim.withColumns({"keep_id": F.col("doc_id"), "copies": F.lit(1).cast("long")}))
    near = F.broadcast if n_hits <= FILTER_MAX_HITS else (lambda x: x)
    # byte verification: only the texts of hits are shuffled
    wanted = near(hits.select("digest"))
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("digest", digest(F.col("text")))
    texts = texts.join(wanted, "digest", "left_semi")
    winners = texts.join(near(hits.select("digest", "keep_id")), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # cut, so that both sides of the next join are shuffled for it and a large group can be split
    winners = cut(winners.groupBy("digest").agg(F.first("text").alias("winner")))
    differ = cut(texts.join(winners, "digest").where("text <> winner").select("digest")).distinct()
    if differ.isEmpty():
        return _verdicts(_with_hits(slim, near(hits)))
    # a collision: these digests' groups are told apart by the whole text
    texts = texts.join(differ, "digest", "left_semi")
    finer = texts.groupBy("digest", "text").agg(index.pick("doc_id").alias("keep_id"), F.count("*").alias("copies"))
    finer = finer.select("digest", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "copies")
    plain = _with_hits(slim.join(differ, "digest", "left_anti"), hits)
    return _verdicts(plain.unionByName(slim.join(finer, ["digest", "sha"]).select(plain.columns)))


def _with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``rows`` with keep_id and copies: those of their digest if it is a hit, else their own."""
    hits = hits.withColumnRenamed("keep_id", "_keep").withColumnRenamed("copies", "_copies")
    keep = F.when(F.col("_copies").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return rows.join(hits, "digest", "left").select("digest", "doc_id", "sha", keep.alias("keep_id"), F.coalesce("_copies", F.lit(1).cast("long")).alias("copies"))


def _verdicts(own: DataFrame) -> DataFrame:
    return own.select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; one row for each distinct text.

    Edge cases are as in :func:`exact_groups`. Rows without a copy are never
    shuffled while the hits are few enough to broadcast.
    """
    folder = new_folder(docs.sparkSession)
    groups = cut(exact_groups(docs, keep, folder=folder).where("group_size > 1").withColumn("sha", F.unhex("text_sha256")))
    remove(docs.sparkSession, folder)  # nothing reads the index any more
    drops = groups.where("NOT kept").select(F.col("doc_id").alias("mark_id"), F.col("sha").alias("mark_sha")).distinct()
    again = groups.where("kept").groupBy("doc_id", "sha").count().where("count > 1")
    again = again.select(F.col("doc_id").alias("mark_id"), F.col("sha").alias("mark_sha"), F.lit(True).alias("again"))
    marks = cut(drops.withColumn("again", F.lit(False)).unionByName(again))
    few = marks.count() <= FILTER_MAX_HITS
    rows = docs.select(as_row(docs), F.col("doc_id").alias("id"), F.unhex(F.sha2(text_of(), 256)).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("sha") == F.col("mark_sha"))
    near = F.broadcast if few else (lambda x: x)
    rest = rows.join(near(marks), same, "left_anti")
    if not again.isEmpty():
        # rows that repeat doc_id and text: one of each stays
        repeated = rows.join(near(marks.where("again")), same, "left_semi")
        rest = rest.unionByName(repeated.dropDuplicates(["id", "sha"]))
    return from_row(rest, docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    out = cut(exact_groups(table(spark, sf_dir, "documents"), keep="max", folder=folder))
    remove(spark, folder)  # nothing reads the index any more
    return out


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
