"""Queries on published tables: guarded versions, newest day, month files, retention, covered sources, a feed with two directions."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import tape
from tapeloom.plans.queries import bars, days, query
from tapeloom.sources import adapters, publish
from tapeloom.storage import cut, remove, shared_dir


def scratch(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def summary(s, d, day: str, source: str) -> DataFrame:
    """A day's summary: full rows have intraday fields, rows of scores alone have none."""
    x = tape.order_flow(days(s, d)).where(F.col("date") == F.lit(day).cast("date"))
    real = lambda c: c if source == publish.FULL else F.lit(0)
    return x.select(F.col("instrument").alias("ticker"), F.lit(day).cast("date").alias("date"), F.lit(source).alias("source"), real(F.col("delta")).cast("long").alias("net_delta"), real(F.col("vol")).cast("long").alias("vol"), F.col("candles").alias("score"))


@query("c17_carried_summary", """
, old AS (SELECT instrument AS ticker, DATE '2024-01-10' AS date, 'FULL' AS source, delta AS net_delta, vol, candles AS score FROM d WHERE date = DATE '2024-01-10'),
sc AS (SELECT instrument AS ticker, DATE '2024-01-11' AS date, candles AS score FROM d WHERE date = DATE '2024-01-11'),
more AS (SELECT * FROM sc UNION ALL SELECT DISTINCT p_brand, DATE '2024-01-11', 1 FROM part)
SELECT 'kept' AS done, * FROM old
UNION ALL SELECT 'carried', m.ticker, m.date, CASE WHEN o.ticker IS NOT NULL THEN 'FULL_CARRIED' ELSE 'ZSCORE' END, coalesce(o.net_delta, 0), coalesce(o.vol, 0), m.score FROM more m LEFT JOIN old o USING (ticker)
UNION ALL SELECT 'published', ticker, date, 'ZSCORE', 0, 0, score FROM sc""", "d")  # fmt: skip
def _(s, d):
    """Three publications after the same full version: as many scores and a closed market, many more of them, and an open market."""
    old, scores = cut(summary(s, d, "2024-01-10", publish.FULL)), cut(summary(s, d, "2024-01-11", publish.SCORES))
    brands = adapters.read(s, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
    zero = F.lit(0).cast("long")
    more = scores.unionByName(brands.select("ticker", F.lit("2024-01-11").cast("date").alias("date"), F.lit(publish.SCORES).alias("source"), zero.alias("net_delta"), zero.alias("vol"), F.lit(1).cast("long").alias("score")))
    out = None
    for new, market_open in ((scores, False), (more, False), (scores, True)):
        place = publish.Publication(s, scratch(s, "summary"))
        publish.publish_summary(place, old, "ticker", True)
        done = publish.publish_summary(place, new, "ticker", market_open)
        rows = cut(place.read().withColumn("done", F.lit(done)))
        remove(s, place.folder)
        out = rows if out is None else out.unionByName(rows)
    return out


def stored_days(s, d) -> str:
    """The day rows as a table partitioned by date, in the shared folder."""
    folder = scratch(s, "days")
    days(s, d).select("instrument", "date", "vol").repartition("date").write.partitionBy("date").parquet(folder)
    return folder


@query("a27_newest_published", "SELECT instrument, date, vol FROM d WHERE date = (SELECT max(date) FROM d WHERE date < DATE '2024-01-29' AND date >= DATE '2024-01-22' AND dayofweek(date) BETWEEN 1 AND 5)", "d")
def _(s, d):
    """A Monday without data yet: the newest trading day of the week before."""
    folder = stored_days(s, d)
    out = cut(publish.read_newest(s, folder, datetime.date(2024, 1, 29)).select("instrument", "date", "vol"))
    remove(s, folder)
    return out


@query("s19_dropped_partitions", "SELECT instrument, date, vol FROM d WHERE date >= DATE '2024-01-20' - 7", "d")
def _(s, d):
    folder = stored_days(s, d)
    publish.retain(s, {folder: 7}, datetime.date(2024, 1, 20))
    out = cut(s.read.parquet(folder).select("instrument", "date", "vol"))
    remove(s, folder)
    return out


@query("s14_month_files", """SELECT ticker, date, CAST(vol AS DOUBLE) * CASE WHEN date BETWEEN DATE '1995-03-10' AND DATE '1995-06-20' THEN 2 ELSE 1 END AS vol
FROM (SELECT o_orderpriority AS ticker, o_orderdate::DATE AS date, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS vol FROM orders GROUP BY ALL)""")  # fmt: skip
def _(s, d):
    """Daily totals by month files: all but the newest first, then a revision of some months, then the rest."""
    o = adapters.read(s, d, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    rows = cut(o.groupBy("ticker", "date").agg(F.sum("v").cast("double").alias("vol")))
    folder, day = scratch(s, "months"), lambda t: F.lit(t).cast("date")
    publish.merge_months(rows.where(F.col("date") < day("1997-01-01")), folder, ["ticker"])
    publish.merge_months(rows.where(F.col("date").between(day("1995-03-10"), day("1995-06-20"))).withColumn("vol", F.col("vol") * 2), folder, ["ticker"])
    publish.merge_months(rows.where(F.col("date") >= day("1996-12-01")), folder, ["ticker"])
    out = cut(s.read.parquet(folder).select("ticker", "date", "vol"))
    remove(s, folder)
    return out


#: The second source names its instruments by position.
NAMES = ("click", "error", "purchase", "signup", "view", "other")


@query("u06_covered_sources", """
, a AS (SELECT instrument, date, bucket, vol FROM c), g AS (SELECT instrument, date FROM a GROUP BY ALL HAVING max(bucket) >= date + CASE WHEN date = DATE '2024-01-29' THEN INTERVAL '8 hours 5 minutes' ELSE INTERVAL '8 hours 50 minutes' END),
b AS (SELECT ['click', 'error', 'purchase', 'signup', 'view', 'other'][o_custkey % 6 + 1] AS instrument, CAST(DATE '2024-01-01' + CAST(o_orderkey % 35 AS INT) AS DATE) AS date,
  DATE '2024-01-01' + CAST(o_orderkey % 35 AS INT) + CAST(o_custkey % 24 AS INT) * INTERVAL '1 hour' AS bucket, count(*) AS vol FROM orders GROUP BY ALL)
SELECT *, 'first' AS origin FROM a SEMI JOIN g USING (instrument, date) UNION ALL SELECT *, 'second' FROM b ANTI JOIN g USING (instrument, date)""", "c")  # fmt: skip
def _(s, d):
    """Candles of the tape where they reach the session's end, else those of another feed (made from orders): whole ticker-days of one origin."""
    first = bars(s, d).select("instrument", "date", F.col("bucket").cast("timestamp").alias("bucket"), "vol")
    o = adapters.read(s, d, "orders")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("o_custkey") % len(NAMES) + 1).cast("int"))
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 35).cast("int"))
    second = o.select(name.alias("instrument"), date.alias("date"), (F.col("o_custkey") % 24).cast("int").alias("h"))
    second = second.groupBy("instrument", "date", "h").agg(F.count("*").alias("vol"))
    second = second.select("instrument", "date", (F.col("date").cast("timestamp") + F.make_dt_interval(hours="h")).alias("bucket"), "vol")
    cutoff = publish.end_cutoff(F.col("date"), F.lit("2024-01-29 08:20:00").cast("timestamp"))
    out = publish.covered(first, second, ["instrument", "date"], "bucket", cutoff)
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


FEED = "SELECT 'order' AS kind, o_orderkey AS id, o_orderdate::TIMESTAMP AS moment FROM orders UNION ALL SELECT 'event', event_id, ts FROM events"


@query("u02_feed_both_ways", f"""
SELECT 'window' AS page, * FROM (SELECT *, false AS backward FROM ({FEED}) WHERE moment BETWEEN TIMESTAMP '1998-07-15' AND TIMESTAMP '2024-01-03' ORDER BY moment, kind, id LIMIT 200)
UNION ALL SELECT 'none', * FROM (SELECT *, true AS backward FROM ({FEED}) ORDER BY moment DESC, kind, id LIMIT 200)""")  # fmt: skip
def _(s, d):
    """A window with entries, and one in the future, where the newest entries come instead; a feed has 200 entries at most."""
    o = adapters.read(s, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("moment"))
    e = adapters.read(s, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    window = publish.feed([o, e], at("1998-07-15"), at("2024-01-03"), 200).withColumn("page", F.lit("window"))
    return window.unionByName(publish.feed([o, e], at("2030-01-01"), None, 200).withColumn("page", F.lit("none")))
