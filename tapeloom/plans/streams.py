"""Queries on micro-batches: late trades and their repair, counts by batch, day states of a stream of bars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import tape
from tapeloom.plans.queries import DAY_SUMMARY, NEEDS, PARTS, query, r6
from tapeloom.plans.session import minutes
from tapeloom.sources import adapters
from tapeloom.storage import cut, remove, shared_dir
from tapeloom.streaming import day_state, repair

#: How the trades of a month arrive: in batches of twelve days, every seventh trade a batch late, every fifth once more in the batch after.
ARRIVALS = 5
FIRST = "(day(ts) - 1) div 12 + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END"

PARTS |= {
    "ev": r"""SELECT event_type AS instrument, ts, event_id AS seq, date_trunc('minute', ts) AS bucket, value > 0 AND coalesce(TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT), 0) > 0 AS ok,
              (day(ts) - 1) // 12 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS batch FROM events""",
    "ar": "SELECT *, false AS again FROM ev UNION ALL SELECT * REPLACE (batch + 1 AS batch), true AS again FROM ev WHERE seq % 5 = 0",
    "hi": "SELECT batch, max(high) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '5 minutes' AS wm FROM (SELECT batch, max(ts) FILTER (ok) AS high FROM ar GROUP BY batch)",
    "la": "SELECT ar.*, ok AND NOT again AND coalesce(bucket + INTERVAL '1 minute' <= wm, false) AS late FROM ar JOIN hi USING (batch)",
}
NEEDS |= {"ar": ["ev"], "hi": ["ar"], "la": ["hi"]}


def arrivals(s, d) -> DataFrame:
    """Trades as they arrive, with their batch."""
    t = adapters.ticks(s, d)
    good = F.coalesce((F.col("price") > 0) & (F.col("qty") > 0), F.lit(False))
    t = t.select("instrument", F.col("ts").cast("timestamp").alias("ts"), "seq", "price", "qty", F.lpad(F.col("seq").cast("string"), 18, "0").alias("hash_id"), F.when(~good, "value").alias("reject"))
    first = t.withColumn("batch", F.expr(FIRST))
    return first.unionByName(first.where("seq % 5 = 0").withColumn("batch", F.col("batch") + 1))


def landed(s, d) -> repair.Ledger:
    """A ledger in the shared folder that has taken in all batches; the last one closes every minute."""
    ledger, rows = repair.Ledger(s, f"{shared_dir(s)}/ledger-{uuid.uuid4().hex}", hours=24), arrivals(s, d)
    for k in range(ARRIVALS):
        ledger.land(rows.where(F.col("batch") == k), k, closes="2100-01-01" if k == ARRIVALS - 1 else None)
    return ledger


@query("st07_late_repair", "SELECT c1.*, coalesce(late, 0)::BIGINT AS late_trades FROM c1 LEFT JOIN (SELECT instrument, bucket, count(*) AS late FROM la WHERE late GROUP BY ALL) USING (instrument, bucket)", "c1", "la")
def _(s, d):
    ledger = landed(s, d)
    ledger.repair()
    late = ledger.late().groupBy("instrument", "bucket").agg(F.sum("trades").alias("late_trades"))
    out = ledger.candles().drop("hour").join(late, ["instrument", "bucket"], "left").withColumn("late_trades", F.coalesce("late_trades", F.lit(0).cast("long")))
    out = cut(out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))
    remove(s, ledger.root)
    return out


@query("st01_batch_counts", "SELECT batch, count(*) FILTER (ok AND NOT again) AS accepted, count(*) FILTER (ok AND again) AS repeated, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (late) AS late FROM la GROUP BY batch", "la")
def _(s, d):
    ledger = landed(s, d)
    out = cut(ledger.counts().withColumn("batch", F.col("batch").cast("long")))
    remove(s, ledger.root)
    return out


#: Three deliveries of bars; the 10th to the 12th come twice.
DELIVERIES = ("day(bucket) <= 12", "day(bucket) BETWEEN 10 AND 20", "day(bucket) > 20")


@query("st10_day_state", DAY_SUMMARY.replace("FROM c)", "FROM c1)") + " WHERE date < (SELECT max(date) FROM t)", "c1")
def _(s, d):
    """The summary of every day that the stream has closed; the last one is still open."""
    root = f"{shared_dir(s)}/days-{uuid.uuid4().hex}"
    bars = cut(tape.candles(minutes(s, d)).select("instrument", F.col("bucket").cast("timestamp").alias("bucket"), *[x.split()[0] for x in day_state.BAR.split(", ")]))
    for part in DELIVERIES:  # one file each, so that each is a batch
        bars.where(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    name, value = day_state.STORE
    old = s.conf.get(name)
    s.conf.set(name, value)
    try:
        stream = s.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        run = day_state.write_days(day_state.day_states(stream), f"{root}/closed", f"{root}/state")
        run.awaitTermination()
    finally:
        s.conf.set(name, old)
    out = cut(tape.day_summary(day_state.timeline(s.read.parquet(f"{root}/closed"))))
    remove(s, root)
    return r6(out, "hidden_acc")
