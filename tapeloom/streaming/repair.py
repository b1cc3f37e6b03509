"""Trades by micro-batch: an append-only tape, candles of closed minutes, a side table of late trades, and the repair of the hours they touch.

Folders below the root::

    tape/batch=K/date=D/hour=H   accepted trades of batch K, late ones marked
    late/batch=K                 the minutes that late trades of batch K belong to
    marks/batch=K                the newest event time so far and the batch's counts
    candles/date=D/hour=H        candles, one row for each instrument and minute
    repairs/upto=K               the hours that a repair rebuilt; K is the last batch it took in

Everything that a batch writes is named by its number and depends only on the
batches before it, so a batch that is run again writes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import tape
from tapeloom.storage import cut, exists, listed

#: The columns of each table; batch, date and hour are partitions.
SCHEMAS = {
    "tape": "ts timestamp, instrument string, price double, qty long, hash_id string, late boolean, batch int, date date, hour int",
    "late": "date date, hour int, instrument string, bucket timestamp, trades long, batch int",
    "marks": "high long, accepted long, repeated long, rejected long, late long, batch int",
    "candles": "instrument string, bucket timestamp, open double, high double, low double, close double, vol long, delta long, trades long, date date, hour int",
}
CANDLE_KEY = ["instrument", "bucket"]


def slot() -> Column:
    """The number of a row's hour, from the partition columns alone: a condition on it prunes partitions."""
    return F.unix_date("date") * 24 + F.col("hour")


def slotted(rows: DataFrame, ts: str, hours: int = 1) -> DataFrame:
    """Add the partition columns: the date and the first hour of the ``hours`` that a partition spans."""
    return rows.withColumn("date", F.to_date(ts)).withColumn("hour", F.hour(ts) - F.hour(ts) % hours)


def merge_candles(new: DataFrame, folder: str, hours: int = 1) -> None:
    """Put candles into the table of ``folder``: by instrument and bucket the new one wins.

    Only the hours that ``new`` has are read and replaced; all others keep their
    files. The merged rows are stored before the old ones go, so a failed job
    can be run again.
    """
    spark = new.sparkSession
    new = cut(slotted(new, "bucket", hours))
    slots = [r[0] for r in new.select(slot().alias("s")).distinct().collect()]  # the hours of one batch
    if not slots:
        return
    if exists(spark, folder):
        old = spark.read.schema(new.schema).parquet(folder).where(slot().isin(slots))
        new = cut(new.unionByName(old.join(new, CANDLE_KEY, "left_anti")))
    new.repartition("date", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "hour").parquet(folder)


class Ledger:
    """Tape, candles and marks below ``root``; :meth:`land` is the function for ``foreachBatch``.

    A partition spans ``hours`` hours: more where hours hold few trades.
    """

    def __init__(self, spark: SparkSession, root: str, delay_seconds: int = 300, width: str = "1 minute", hours: int = 1):
        self.spark, self.root, self.delay, self.width, self.hours = spark, root.rstrip("/"), delay_seconds * 1_000_000, width, hours

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if exists(self.spark, path) else None

    def _write(self, df: DataFrame, name: str, batch: int, *by: str) -> DataFrame:
        path = f"{self.root}/{name}/batch={batch}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _ends(self) -> Column:
        """When a trade's bucket ends, in microseconds."""
        return F.unix_micros(tape.floored("ts", self.width) + F.expr(f"INTERVAL {self.width}"))

    def watermark(self, before: int | None = None) -> int | None:
        """The time, in microseconds, behind which trades count as late after all batches (those below ``before``); None at the start."""
        marks = self._read("marks")
        if marks is None:
            return None
        marks = marks if before is None else marks.where(F.col("batch") < before)
        high = marks.agg(F.max("high")).first()[0]
        return None if high is None else high - self.delay

    def land(self, batch: DataFrame, number: int, closes: str | None = None) -> None:
        """Take in one batch of trades (ts, instrument, price, qty, hash_id, reject) and publish the minutes that it closes.

        Rejected trades are counted, repeated ones dropped against the stored
        trades of their hours. A trade whose minute was closed before the batch
        is late: it is stored and marked, its minute waits for :meth:`repair`.
        ``closes`` is a time by which all minutes are closed, as a session's end.
        """
        before = self.watermark(number)
        batch = batch.persist()
        good = F.col("reject").isNull()
        seen = batch.agg(
            F.count("*").alias("rows"),
            F.count_if(~good).alias("rejected"),
            F.unix_micros(F.max(F.when(good, F.col("ts")))).alias("high"),
            (F.unix_micros(F.lit(closes).cast("timestamp")) + self.delay).alias("closes"),
        ).first()
        trades = batch.where(good).select("ts", "instrument", F.col("price").cast("double").alias("price"), F.col("qty").cast("long").alias("qty"), "hash_id").dropDuplicates(["hash_id"])
        trades = trades.withColumn("late", F.lit(False) if before is None else self._ends() <= before)
        trades = slotted(trades, "ts", self.hours)
        stored = self._read("tape")
        if stored is not None:
            hours = [r[0] for r in trades.select(slot().alias("s")).distinct().collect()]  # a repeated trade lies in the same hour
            stored = stored.where((F.col("batch") != number) & slot().isin(hours))
            trades = trades.join(stored.select("hash_id"), "hash_id", "left_anti")
        landed = self._write(trades, "tape", number, "date", "hour")
        batch.unpersist()
        minutes = landed.where("late").groupBy("date", "hour", "instrument", tape.floored("ts", self.width).alias("bucket")).agg(F.count("*").alias("trades"))
        late = self._write(minutes, "late", number).agg(F.coalesce(F.sum("trades"), F.lit(0))).first()[0]
        accepted = landed.count()
        high = max((x for x in (seen.high, seen.closes, None if before is None else before + self.delay) if x is not None), default=None)
        self._publish(before, None if high is None else high - self.delay, number)
        mark = (high, accepted, seen.rows - seen.rejected - accepted, seen.rejected, late)
        self._write(self.spark.createDataFrame([mark], "high long, accepted long, repeated long, rejected long, late long"), "marks", number)

    def _candles(self, trades: DataFrame) -> DataFrame:
        t = trades.select("ts", "instrument", "price", "qty", F.col("hash_id").alias("seq"))
        return tape.candles(tape.signed(t.withColumn("date", F.to_date("ts")).withColumn("bucket", tape.floored("ts", self.width))))

    def _publish(self, before: int | None, after: int | None, number: int) -> None:
        """Candles of the minutes that end after ``before`` and by ``after``."""
        if after is None or after == before:
            return
        day = 86_400_000_000
        date = F.unix_date("date")  # whole days of any time zone around the minutes: prunes partitions
        trades = self._read("tape").where((F.col("batch") <= number) & ~F.col("late") & (self._ends() <= after) & (date <= after // day + 1))
        if before is not None:
            trades = trades.where((self._ends() > before) & (date >= before // day - 1))
        merge_candles(self._candles(trades), f"{self.root}/candles", self.hours)

    def repair(self) -> list[tuple]:
        """Rebuild the hours that late trades touched since the last repair, from the whole tape of these hours; returns (date, hour) of each.

        Run again it finds nothing to do; broken off, it does the same again.
        """
        late, marks = self._read("late"), self._read("marks")
        if marks is None:
            return []
        done = [int(x.partition("=")[2]) for x in listed(self.spark, f"{self.root}/repairs") if x.startswith("upto=")]
        last = marks.agg(F.max("batch")).first()[0]
        late = late.where((F.col("batch") <= last) & (F.col("batch") > max(done, default=-1)))
        hours = cut(late.groupBy("date", "hour").agg(F.sum("trades").alias("trades")))
        touched = sorted((r.date, r.hour) for r in hours.collect())
        if not touched:
            return []
        numbers = [r[0] for r in hours.select(slot().alias("s")).collect()]
        trades = self._read("tape").where(slot().isin(numbers) & (F.col("batch") <= last) & (self._ends() <= self.watermark()))
        merge_candles(self._candles(trades), f"{self.root}/candles", self.hours)
        hours.write.mode("overwrite").parquet(f"{self.root}/repairs/upto={last}")
        return touched

    def candles(self) -> DataFrame:
        return self._read("candles")

    def late(self) -> DataFrame:
        """The side table: (date, hour, instrument, bucket, trades) of each batch's late trades."""
        return self._read("late")

    def counts(self) -> DataFrame:
        """(batch, accepted, repeated, rejected, late) of every batch."""
        return self._read("marks").select("batch", "accepted", "repeated", "rejected", "late")


def write_ledger(trades: DataFrame, ledger: Ledger, checkpoint: str):
    """Run ``land`` for every micro-batch of a stream of normalised trades; returns the running query, which ends when the input is used up."""
    return trades.writeStream.foreachBatch(ledger.land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
