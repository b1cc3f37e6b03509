"""Reading and publishing tables: priorities, upserts, retention, atomic publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.relational import first_of

CANDLE = "ticker string, t0 bigint, ohlc struct<o:double,h:double,l:double,c:double>, vol double, delta double, levels array<struct<p:double,bv:double,av:double>>"


def read_candles(spark: SparkSession, folder: str) -> DataFrame:
    """Candles of NDJSON files; malformed lines are left out.

    Of rows with one ticker and t0 that of the file that came last stays, and
    in one file that with the larger volume: candles only grow.
    """
    rows = spark.read.schema(CANDLE).option("mode", "DROPMALFORMED").json(folder).where("t0 IS NOT NULL")
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_name").alias("_file"))
    last = rows.groupBy("ticker", "t0").agg(F.max_by(F.struct("ohlc", "vol", "delta", "levels", "arrived"), F.struct("arrived", "_file", "vol")).alias("_r"))
    return last.select("ticker", "t0", "_r.*").withColumn("bucket", F.timestamp_millis("t0"))


def by_priority(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of sources of one schema; of equal keys the row of the earliest source stays."""
    out = None
    for k, df in enumerate(sources):
        df = df.withColumn("_p", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return first_of(out, key, [F.asc("_p")]).drop("_p")


def upserted(old: DataFrame, new: DataFrame, key: list[str], backfill: bool = False) -> DataFrame:
    """Old and new rows, one per key: the new one, in a backfill the old one."""
    return by_priority([old, new] if backfill else [new, old], key)


def write_days(df: DataFrame, path: str, date: str = "date") -> None:
    """Replace the days that ``df`` has, leave all others; a failed job changes nothing."""
    df.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def write_parts(df: DataFrame, path: str, by: tuple = ("date", "hour"), ts: str = "ts") -> None:
    """Add rows to a table partitioned by ``by``: of these, date and hour come from ``ts``; raw tape by (date, hour), books by (symbol, date, hour)."""
    d = df.withColumns({k: f(ts) for k, f in (("date", F.to_date), ("hour", F.hour)) if k in by and k not in df.columns})
    # an hour's rows of one symbol meet in one file, a busy hour is split by the writer's limit on rows
    d.repartition(*by).write.mode("append").option("maxRecordsPerFile", 1_000_000).partitionBy(*by).parquet(path)


def last_days(rows: DataFrame, calendar: DataFrame, until: Column, n: int, date: str = "date") -> DataFrame:
    """Rows of the last ``n`` trading days up to ``until``, with ``day_offset`` (0 is the newest).

    ``calendar`` has date and day_index, one row a trading day; the dates
    prune a table that is partitioned by date.
    """
    known = calendar.where(F.col("date") <= until)
    newest = known.agg(F.max("day_index").alias("newest"))
    days = known.crossJoin(newest).select(F.col("date").alias(date), (F.col("newest") - F.col("day_index")).alias("day_offset")).where(F.col("day_offset") < n)  # one row beside a calendar
    return rows.join(days, date)


def kept_since(df: DataFrame, today: Column, days: int, date: str = "date") -> DataFrame:
    """Rows of the last ``days`` days; on a table partitioned by date this prunes files."""
    return df.where(F.col(date) >= F.date_sub(today, days))


def guarded(new: DataFrame, old: DataFrame, growth: float = 1.2, full: str = "FULL") -> DataFrame:
    """The summary to publish: the old one stays if it is full and the new one has not ``growth`` times its rows and none full."""
    counts = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("source") == full), F.lit(False)).alias("full"))
    a, b = counts(new).toDF("n_new", "new_full"), counts(old).toDF("n_old", "old_full")
    # one row each
    keep_old = a.crossJoin(b).select((F.col("old_full") & ~F.col("new_full") & (F.col("n_new") <= growth * F.col("n_old"))).alias("keep_old"))
    pick = lambda df, cond: df.join(F.broadcast(keep_old.where(cond)), how="cross").drop("keep_old")
    return pick(new, "NOT keep_old").unionByName(pick(old, "keep_old"))


def master_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action): insert, update, skip or absent, by comparing the newest rows of both sides."""
    n = new.dropDuplicates([key]).select(F.col(key), F.struct(*columns).alias("n"))
    o = old.select(F.col(key), F.struct(*columns).alias("o"))
    both = n.join(o, key, "full")
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "absent").when(F.col("n") != F.col("o"), "update").otherwise("skip")
    return both.select(key, action.alias("action"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """Rows by action of a :func:`master_diff`: the line that an audit table keeps."""
    actions = ("insert", "update", "skip", "absent")
    return diff.agg(*[F.count_if(F.col("action") == a).alias(f"{a}s") for a in actions])
