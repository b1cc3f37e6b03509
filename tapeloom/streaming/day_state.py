"""The state of every instrument's day: minutes replace each other, the day's totals follow, a closed day leaves the state."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a minute brings besides its bucket.
BAR = "open double, high double, low double, close double, vol long, delta long, trades long"
DAY = f"instrument string, date date, open double, high double, low double, close double, vol long, delta long, candles long, closed boolean, bars array<struct<bucket:timestamp,{BAR.replace(' ', ':').replace(',:', ',')}>>"

#: transformWithState needs this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class DayProcessor(StatefulProcessor):
    """Keeps the minutes of one (instrument, date) by bucket: at most as many as a day has minutes.

    A minute that comes again replaces the stored one, so totals never count it
    twice. At the day's end plus ``grace`` seconds of event time the day is
    given out as closed, with all its bars, and its state goes. What comes for
    a closed day is left to the repair of its hours.
    """

    def __init__(self, grace: int = 0, running: bool = False):
        self.grace, self.running = grace, running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "bucket long", BAR)

    def _closes(self, key) -> int:
        """Milliseconds at which the day of ``key`` is closed."""
        return ((key[1] - datetime.date(1970, 1, 1)).days + 1) * 86_400_000 + self.grace * 1000

    def _day(self, key, closed: bool):
        import pandas as pd

        found = sorted((k[0], *v) for k, v in self.minutes.iterator())
        names = ["bucket", *[x.split()[0] for x in BAR.split(", ")]]
        rows = [dict(zip(names, x, strict=True)) for x in found]
        bars = [r | {"bucket": pd.Timestamp(r["bucket"], unit="us", tz="UTC")} for r in rows] if closed else []
        total = lambda c: sum(r[c] for r in rows)
        day = [key[0], key[1], rows[0]["open"], max(r["high"] for r in rows), min(r["low"] for r in rows), rows[-1]["close"], total("vol"), total("delta"), len(rows), closed, bars]
        return pd.DataFrame({f.split()[0]: [x] for f, x in zip(DAY.partition(", bars")[0].split(", "), day, strict=False)} | {"bars": [bars]})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        closes = self._closes(key)
        if timerValues.getCurrentWatermarkInMs() >= closes:
            return
        for part in rows:
            for r in part.sort_values("trades").itertuples(index=False):
                self.minutes.updateValue((r.at,), (r.open, r.high, r.low, r.close, int(r.vol), int(r.delta), int(r.trades)))
        self.handle.registerTimer(closes)
        if self.running:
            yield self._day(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.minutes.exists():
            yield self._day(key, True)
            self.minutes.clear()

    def close(self) -> None:
        pass


def day_states(bars: DataFrame, delay: str = "10 minutes", grace: int = 0, running: bool = False) -> DataFrame:
    """Days of a stream of minute bars (instrument, bucket and those of ``BAR``); see ``DAY`` for the columns.

    Closed days come out once, with their bars; with ``running`` the totals of
    a day come out too whenever it changes (output mode update). Days are those
    of UTC. Of rows of one minute the one that came in a later batch counts;
    within a batch, that with more trades, as minutes only grow.
    """
    rows = bars.withWatermark("bucket", delay)
    rows = rows.select("instrument", F.to_date("bucket").alias("date"), F.unix_micros("bucket").alias("at"), "bucket", *[x.split()[0] for x in BAR.split(", ")])
    return rows.groupBy("instrument", "date").transformWithStateInPandas(DayProcessor(grace, running), DAY, "update" if running else "append", "eventTime")


def timeline(days: DataFrame) -> DataFrame:
    """The bars of closed days, as the day's summary and timeline take them."""
    return days.where("closed").select("instrument", "date", F.explode("bars").alias("b")).select("instrument", "date", "b.*")


def write_days(days: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Write each batch's rows to ``folder``, by batch: a batch that is run again replaces its rows. Returns the running query."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return days.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
