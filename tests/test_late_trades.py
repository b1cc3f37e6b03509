"""Late trades and their repair, day states and batch counts, on streams of files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import tape
from tapeloom.plans import session
from tapeloom.streaming import candles, counts, day_state, repair

SF = "/root/testdata/sf0.001"
BASE = 1_767_664_800_000  # 2026-01-06 02:00:00 UTC


def line(seconds, price, qty, code="AADI", board="RG"):
    h, rest = divmod(9 * 3600 + seconds, 3600)
    return {"v": 1, "fmt": "pipe", "src": "lt", "ts": BASE, "raw": f"20260106|{h:02d}{rest // 60:02d}{rest % 60:02d}|0|{code}|{board}|T|{price}|{qty}"}


def files(folder, batches):
    """One file for each batch, the older first."""
    folder.mkdir(exist_ok=True)
    have = len(list(folder.iterdir()))
    for k, lines in enumerate(batches, start=have):
        (folder / f"{k}.ndjson").write_text("\n".join(map(json.dumps, lines)) + "\n")
        time.sleep(0.02)


def stream(spark, folder):
    return candles.normalised(spark.readStream.schema(candles.ENVELOPE).option("maxFilesPerTrigger", 1).json(str(folder)))


FIRST = [line(10, 100, 10), line(20, 101, 20), line(65, 100, 40), line(70, 100, 1, board="NG")]
SECOND = [line(3700, 90, 5), line(20, 101, 20), line(50, 99, 30)]  # 50 s lies behind no watermark yet
THIRD = [line(40, 200, 7), line(3705, 91, 6), line(7300, 80, 1)]  # 40 s is late: 02:00 was closed by the second
FOURTH = [line(9999, 1, 1, code="ZZZZ")]


def rows(df):
    return sorted((r.instrument, r.bucket.strftime("%H:%M"), r.open, r.high, r.low, r.close, r.vol, r.delta, r.trades) for r in df.collect())


def contents(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*.parquet")}


def test_late_trade_is_repaired_once_and_replays_change_nothing(spark, tmp_path):
    files(tmp_path / "in", [FIRST, SECOND, THIRD, FOURTH])
    ledger = repair.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.repair() == []
    q = repair.write_ledger(stream(spark, tmp_path / "in"), ledger, str(tmp_path / "check"))
    assert q.awaitTermination(240) and q.exception() is None
    assert [tuple(r) for r in ledger.counts().orderBy("batch").collect()] == [(0, 3, 0, 1, 0), (1, 2, 1, 0, 0), (2, 3, 0, 0, 1), (3, 1, 0, 0, 0)]
    early = [("AADI", "02:00", 100, 101, 99, 99, 60, -10, 3), ("AADI", "02:01", 100, 100, 100, 100, 40, 0, 1), ("AADI", "03:01", 90, 91, 90, 91, 11, 6, 2), ("AADI", "04:01", 80, 80, 80, 80, 1, 0, 1)]
    assert rows(ledger.candles()) == early
    before = contents(tmp_path / "ledger" / "candles")
    assert [(str(d), h) for d, h in ledger.repair()] == [("2026-01-06", 2)]
    mended = [("AADI", "02:00", 100, 200, 99, 99, 67, -3, 4), *early[1:]]
    assert rows(ledger.candles()) == mended
    after = contents(tmp_path / "ledger" / "candles")
    other = {k: v for k, v in before.items() if "hour=2/" not in k}
    assert other and {k: v for k, v in after.items() if "hour=2/" not in k} == other  # untouched hours keep their files
    assert ledger.repair() == [] and contents(tmp_path / "ledger" / "candles") == after
    # the last batch once more, as after a crash before its commit
    again = candles.normalised(spark.read.schema(candles.ENVELOPE).json(str(tmp_path / "in" / "3.ndjson")))
    ledger.land(again, 3)
    assert rows(ledger.candles()) == mended and ledger.counts().agg(F.sum("accepted")).first()[0] == 9


def test_a_batch_delivered_twice_counts_as_repeated(spark, tmp_path):
    ledger = repair.Ledger(spark, f"file://{tmp_path}/ledger")
    batch = candles.normalised(spark.createDataFrame([json.dumps(x) for x in FIRST[:3]], "string").select(F.from_json("value", candles.ENVELOPE).alias("x")).select("x.*"))
    for k in range(3):
        ledger.land(batch if k < 2 else batch.limit(0), k, closes="2026-01-06 05:00:00" if k == 2 else None)
    assert [tuple(r) for r in ledger.counts().orderBy("batch").collect()] == [(0, 3, 0, 0, 0), (1, 0, 3, 0, 0), (2, 0, 0, 0, 0)]
    assert [r[-1] for r in rows(ledger.candles())] == [2, 1]


def test_listener_counts_each_batch(spark, tmp_path):
    # Spark calls late what is behind the watermark of the batch before
    files(tmp_path / "in", [FIRST, FIRST, [*SECOND, line(30, 1, -1)], THIRD, [line(45, 5, 5), line(7310, 81, 1)]])
    seen = counts.TradeCounts()
    spark.streams.addListener(seen)
    try:
        kept = counts.counted(stream(spark, tmp_path / "in"))
        q = kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if len(seen.batches) == 5:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    got = [tuple(r) for r in seen.table(spark).orderBy("batch").collect()]
    # the duplicate delivery: nothing accepted, the whole batch repeated or rejected
    assert got == [(0, 3, 0, 1, 0), (1, 0, 3, 1, 0), (2, 2, 1, 1, 0), (3, 3, 0, 0, 0), (4, 1, 0, 0, 1)]
    assert spark.table("kept").count() == 9


@pytest.fixture
def rocksdb(spark):
    name, value = day_state.STORE
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, old)


def test_day_states_equal_the_batch_with_a_minute_delivered_twice(spark, tmp_path, rocksdb):
    bars = tape.candles(session.minutes(spark, SF)).select("instrument", "bucket", *[x.split()[0] for x in day_state.BAR.split(", ")])
    half = bars.withColumns({"vol": F.col("vol") - 1, "trades": F.lit(0).cast("long"), "close": F.lit(1.0)})  # a first version of the 15th's minutes
    parts = [bars.where("day(bucket) < 15").unionByName(half.where("day(bucket) = 15")), bars.where("day(bucket) = 15"), bars.where("day(bucket) BETWEEN 15 AND 20"), bars.where("day(bucket) > 20")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    source = lambda: spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = day_state.write_days(day_state.day_states(source()), f"file://{tmp_path}/closed", str(tmp_path / "check1"))
    assert q.awaitTermination(240) and q.exception() is None
    closed = spark.read.parquet(f"file://{tmp_path}/closed").drop("batch")
    want = tape.day_summary(tape.candles(session.minutes(spark, SF)).withColumn("date", F.to_date("bucket"))).where("date < '2024-01-30'")
    got = tape.day_summary(day_state.timeline(closed)).select(*want.columns)
    assert got.count() == want.count() and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # running totals: the newest row of a day has each minute once
    q = day_state.write_days(day_state.day_states(source(), running=True), f"file://{tmp_path}/running", str(tmp_path / "check2"), "update")
    assert q.awaitTermination(240) and q.exception() is None
    newest = spark.read.parquet(f"file://{tmp_path}/running").groupBy("instrument", "date").agg(F.max_by(F.struct("vol", "delta", "candles", "high", "low"), "batch").alias("r")).select("instrument", "date", "r.*")
    day = tape.day_rollup(tape.candles(session.minutes(spark, SF)).withColumn("date", F.to_date("bucket"))).select(*newest.columns)
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, day.collect()))
