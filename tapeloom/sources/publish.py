"""Published tables: versions behind a manifest, the newest published day, month files merged by date, retention by partition."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.storage import cut, exists, listed, remove, renamed

FULL, SCORES, CARRIED = "FULL", "ZSCORE", "FULL_CARRIED"
#: Intraday fields of a summary that are taken from the version before where they are 0 or null.
INTRADAY = ("delta_pct", "price_pct", "divergence", "net_delta", "vol", "trades", "open", "close")


class Publication:
    """Versions of a table below ``folder``; the manifest with the highest number names the current one.

    A version's files are complete before its manifest appears, and a manifest
    appears by one rename: readers see the old version or the new one. Of two
    writers of the same number one fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifests(self) -> list[int]:
        return sorted(int(x) for x in listed(self.spark, f"{self.folder}/manifests") if x.isdigit())

    def manifest(self) -> dict | None:
        """What is known of the current version without reading it: number, path, rows, full."""
        numbers = self.manifests()
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{numbers[-1]:08d}").first()[0]) if numbers else None

    def read(self) -> DataFrame | None:
        now = self.manifest()
        return self.spark.read.parquet(now["path"]) if now else None

    def publish(self, table: DataFrame, **known) -> dict:
        """Write ``table`` as the next version and switch to it."""
        numbers = self.manifests()
        number = numbers[-1] + 1 if numbers else 1
        path = f"{self.folder}/versions/{number:08d}-{uuid.uuid4().hex}"
        table.write.parquet(path)
        said = {"number": number, "path": path, "rows": self.spark.read.parquet(path).count(), **known}
        draft = f"{self.folder}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(said),)], "line string").coalesce(1).write.text(draft)
        renamed(self.spark, draft, f"{self.folder}/manifests/{number:08d}")
        return said

    def drop_old(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` versions, manifests first."""
        for number in self.manifests()[:-keep]:
            remove(self.spark, f"{self.folder}/manifests/{number:08d}")
        kept = {f"{n:08d}" for n in self.manifests()}
        for name in listed(self.spark, f"{self.folder}/versions"):
            if name.partition("-")[0] not in kept and (not kept or name.partition("-")[0] < min(kept)):
                remove(self.spark, f"{self.folder}/versions/{name}")


def carried_forward(new: DataFrame, old: DataFrame, key: str, fields: Iterable[str] = INTRADAY) -> DataFrame:
    """``new`` with the intraday fields of the version before where its own are 0 or null.

    Only rows of ``old`` that have intraday data (any source but the scores
    alone) are taken from; rows of a full one are tagged as carried.
    """
    fields = [f for f in fields if f in new.columns and f in old.columns]
    before = old.where(F.col("source") != SCORES).select(F.col(key).alias("_key"), F.col("source").alias("_source"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = new.join(before, F.col(key) == F.col("_key"), "left")
    missing = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) == 0
    filled = {f: F.when(missing(f) & F.col(f"_{f}").isNotNull(), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}
    tag = F.when(F.col("_source") == FULL, CARRIED).otherwise(F.col("source"))
    return both.select(*[filled.get(c, tag if c == "source" else F.col(c)).alias(c) for c in new.columns])


def publish_summary(publication: Publication, new: DataFrame, key: str, market_open: bool, growth: float = 1.2) -> str:
    """Publish a summary (``source`` is FULL, ZSCORE, ...) unless that would lose intraday data; returns what was done.

    While the market is closed a summary of scores alone does not replace one
    that has full rows ("kept"), except if it has more than ``growth`` times its
    rows: then the intraday fields are carried forward ("carried"). Otherwise it
    is published as it is ("published"). Counts of the version before come from
    its manifest.
    """
    new = cut(new)
    counts = new.agg(F.count("*").alias("rows"), F.count_if(F.col("source") == FULL).alias("full"), F.count_if(F.col("source") == SCORES).alias("scores")).first()
    now, done = publication.manifest(), "published"
    if now and not counts.full and counts.scores and not market_open and now.get("full"):
        if counts.rows <= now["rows"] * growth:
            return "kept"
        new, done = carried_forward(new, publication.read(), key), "carried"
    publication.publish(new, full=counts.full)
    return done


def partition_days(spark: SparkSession, folder: str, column: str = "date") -> list[datetime.date]:
    """The days that a table has partitions for, from the names of its folders: no file is read."""
    return sorted(datetime.date.fromisoformat(x.partition("=")[2]) for x in listed(spark, folder) if x.startswith(f"{column}=") and len(x) == len(column) + 11)


def newest_day(spark: SparkSession, folder: str, until: datetime.date, within: int = 7, holidays: Iterable[datetime.date] = (), column: str = "date") -> datetime.date | None:
    """The newest trading day with a partition, from 1 to ``within`` days before ``until``; None if there is none."""
    first = until - datetime.timedelta(days=within)
    days = [d for d in partition_days(spark, folder, column) if first <= d < until and d.weekday() < 5 and d not in set(holidays)]
    return days[-1] if days else None


def read_newest(spark: SparkSession, folder: str, until: datetime.date, within: int = 7, holidays: Iterable[datetime.date] = (), column: str = "date") -> DataFrame | None:
    """The rows of :func:`newest_day`, with the day as a column; the scan lists and reads one partition."""
    day = newest_day(spark, folder, until, within, holidays, column)
    if day is None:
        return None
    return spark.read.option("basePath", folder).parquet(f"{folder}/{column}={day}")


def merge_months(new: DataFrame, folder: str, key: list[str], date: str = "date", form: str = "yyyy-MM") -> list[str]:
    """Merge rows into a table with one folder for each month: of rows with one ``key`` and date the new one stays. Returns the months touched.

    Only the touched months are read. Their merged rows are written beside the
    table first and then take the place of the old folders by renaming: until
    then nothing has changed, and what a broken swap left is put back by the
    next call. All other months keep their files.
    """
    spark = new.sparkSession
    restore(spark, folder)
    new = cut(new.withColumn("month", F.date_format(date, form)))
    months = sorted(r[0] for r in new.select("month").distinct().collect())
    have = set(listed(spark, folder)) if exists(spark, folder) else set()
    old = [m for m in months if f"month={m}" in have]
    merged = new.withColumn("_new", F.lit(1))
    if old:
        rows = spark.read.option("basePath", folder).schema(new.schema).parquet(*[f"{folder}/month={m}" for m in old])
        merged = merged.unionByName(rows.withColumn("_new", F.lit(0)))
    newest = W.partitionBy("month", *key, date).orderBy(F.desc("_new"))
    merged = merged.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "_new")
    stage, gone = f"{folder}/_stage-{uuid.uuid4().hex}", f"{folder}/_gone-{uuid.uuid4().hex}"
    merged.repartition("month").sortWithinPartitions(*key, date).write.partitionBy("month").parquet(stage)
    for m in months:
        if m in old:
            renamed(spark, f"{folder}/month={m}", f"{gone}/month={m}")
        renamed(spark, f"{stage}/month={m}", f"{folder}/month={m}")
    remove(spark, gone)
    remove(spark, stage)
    return months


def restore(spark: SparkSession, folder: str) -> None:
    """Put back the months that a broken swap has taken away and not replaced; remove what else it left."""
    names = listed(spark, folder)
    for gone in (x for x in names if x.startswith("_gone-")):
        for month in listed(spark, f"{folder}/{gone}"):
            if month not in names:
                renamed(spark, f"{folder}/{gone}/{month}", f"{folder}/{month}")
    for left in (x for x in names if x.startswith(("_gone-", "_stage-"))):
        remove(spark, f"{folder}/{left}")


def drop_before(spark: SparkSession, folder: str, today: datetime.date, days: int, column: str = "date") -> list[datetime.date]:
    """Drop the partitions of days more than ``days`` before ``today`` through the file system; returns them. No row is read."""
    limit = today - datetime.timedelta(days=days)
    old = [d for d in partition_days(spark, folder, column) if d < limit]
    for d in old:
        remove(spark, f"{folder}/{column}={d}")
    return old


def retain(spark: SparkSession, limits: dict[str, int], today: datetime.date) -> dict[str, int]:
    """Apply :func:`drop_before` to each folder with its own limit in days; returns how many partitions went."""
    return {folder: len(drop_before(spark, folder, today, days)) for folder, days in limits.items()}


def end_cutoff(date: Column, now: Column, opens: str = "02:00", ends: str = "08:50", closes: str = "09:00", lag: str = "15 minutes") -> Column:
    """When a ticker's last candle of ``date`` must be at least, for the day to count as covered.

    A past day must reach ``ends``; the day of ``now`` the time ``lag`` before
    it, from the opening on and at most until the close.
    """
    at = lambda clock: F.to_timestamp(F.concat(date.cast("string"), F.lit(f" {clock}:00")))
    today = F.greatest(at(opens), now - F.expr(f"INTERVAL {lag}"))
    return F.least(F.when(date == now.cast("date"), today).otherwise(at(ends)), at(closes))


def covered(first: DataFrame, second: DataFrame, key: list[str], ts: str, cutoff: Column) -> DataFrame:
    """All rows of a key from ``first`` if its last one is at ``cutoff`` or later, else all of its rows from ``second``; ``origin`` says which.

    Keys that only ``second`` has come from there; a key that is not covered
    and that ``second`` does not have is left out.
    """
    gate = first.groupBy(*key).agg(F.max(ts).alias("_last")).withColumn("_covered", F.col("_last") >= cutoff)
    good = gate.where("_covered").select(*key)
    kept = first.join(good, key, "left_semi").withColumn("origin", F.lit("first"))
    return kept.unionByName(second.join(good, key, "left_anti").withColumn("origin", F.lit("second")))


def feed(sources: list[DataFrame], since: Column | None, until: Column | None, limit: int, explicit: bool = False) -> DataFrame:
    """The nearest ``limit`` entries (kind, id, moment) of a window, in order; if it has none, the newest ones of all time.

    Every source gives its first ``limit`` entries of either direction, so only
    these are merged. An ``explicit`` window stays empty. ``backward`` marks
    the second direction.
    """
    order = ["moment", "kind", "id"]
    inside = lambda df: df if since is None and until is None else df.where((F.lit(True) if since is None else F.col("moment") >= since) & (F.lit(True) if until is None else F.col("moment") <= until))

    def page(rows: list[DataFrame], by: list[Column]) -> DataFrame:
        best = [df.select(*order).orderBy(*by).limit(limit) for df in rows]
        out = best[0]
        for df in best[1:]:
            out = out.unionByName(df)
        return out.orderBy(*by).limit(limit)

    forward = page([inside(df) for df in sources], [F.asc(c) for c in order])
    if explicit:
        return forward.withColumn("backward", F.lit(False))
    backward = page(sources, [F.desc("moment"), F.asc("kind"), F.asc("id")])
    found = F.broadcast(forward.agg(F.count("*").alias("_n")))  # one row
    second = backward.join(found, how="cross").where("_n = 0").drop("_n")
    return forward.withColumn("backward", F.lit(False)).unionByName(second.withColumn("backward", F.lit(True)))
