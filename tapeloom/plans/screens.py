"""Queries of the screens."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators import flows, rolling, scoring, screens, tape
from tapeloom.plans.queries import CAL, CTX, QUERIES, bars, contexts, days, flow, money, net, query, r6, ticks
from tapeloom.sources import adapters


TODAY = "2024-01-30"


def completeness(s, d):
    """Days with the missing hours of eight and how complete they are."""
    hour = F.hour("bucket")
    missing = bars(s, d).groupBy("instrument", "date").agg((8 - F.count_distinct(F.when(hour.between(2, 9), hour))).alias("missing"))
    x = days(s, d).join(missing, ["instrument", "date"])
    late = F.hour("last_bucket") * 60 + F.minute("last_bucket")
    today = F.lit(TODAY).cast("date")
    return x.withColumn("completeness", F.when(F.col("candles") < 10, "SPARSE_DATA").when((F.col("date") < today) & (late < 1200), "CUT").otherwise("COMPLETE"))


def repair_plan(x):
    return screens.repair_plan(x, F.lit(TODAY).cast("date")).select("instrument", "date", "repair", "priority", "missing_ratio")


@query("p15_repair_plan", """
, h AS (SELECT instrument, date, 8 - count(DISTINCT extract(hour FROM bucket)) FILTER (extract(hour FROM bucket) BETWEEN 2 AND 9) AS missing FROM c GROUP BY ALL),
k AS (SELECT d.*, h.missing, CASE WHEN candles < 10 THEN 'SPARSE_DATA' WHEN date < DATE '2024-01-30' AND extract(hour FROM last_bucket) * 60 + extract(minute FROM last_bucket) < 1200 THEN 'CUT' ELSE 'COMPLETE' END AS st FROM d JOIN h USING (instrument, date))
SELECT instrument, date, st = 'CUT' OR (date <> DATE '2024-01-30' AND st <> 'SPARSE_DATA' AND missing >= 2) AS repair, CASE WHEN st = 'CUT' THEN 'high' ELSE 'normal' END AS priority, CAST(missing AS DOUBLE) / 8 AS missing_ratio FROM k""", "d")  # fmt: skip
def _(s, d):
    return repair_plan(completeness(s, d).withColumn("thin", F.lit(False)))


@query("p15_repair_plan_thin", """
, h AS (SELECT instrument, date, 8 - count(DISTINCT extract(hour FROM bucket)) FILTER (extract(hour FROM bucket) BETWEEN 2 AND 9) AS missing FROM c GROUP BY ALL),
w AS (SELECT instrument, date, bool_or(trades < 2) AS thin FROM (SELECT *, row_number() OVER (PARTITION BY instrument, date ORDER BY bucket) AS k FROM c) WHERE k <= 10 GROUP BY ALL),
k AS (SELECT d.*, h.missing, w.thin, CASE WHEN candles < 10 THEN 'SPARSE_DATA' WHEN date < DATE '2024-01-30' AND extract(hour FROM last_bucket) * 60 + extract(minute FROM last_bucket) < 1200 THEN 'CUT' ELSE 'COMPLETE' END AS st FROM d JOIN h USING (instrument, date) LEFT JOIN w USING (instrument, date))
SELECT instrument, date, coalesce(thin, false) OR st = 'CUT' OR (date <> DATE '2024-01-30' AND st <> 'SPARSE_DATA' AND missing >= 2) AS repair, CASE WHEN st = 'CUT' THEN 'high' ELSE 'normal' END AS priority, CAST(missing AS DOUBLE) / 8 AS missing_ratio FROM k""", "d")  # fmt: skip
def _(s, d):
    return repair_plan(completeness(s, d).join(QUERIES["p16_thin_candles"](s, d), ["instrument", "date"], "left"))


@query("p20_activity_filter", ", a AS (SELECT broker, ticker, sum(net) AS net, sum(buy + sell) AS total FROM n GROUP BY ALL) SELECT broker, ticker, CAST(net AS DOUBLE) AS net FROM a WHERE net > 0 AND total >= 100000 AND broker IN (SELECT broker FROM a GROUP BY 1 HAVING count(DISTINCT ticker) >= 20)", "n")
def _(s, d):
    rows = net(s, d, ("broker", "ticker")).withColumn("total", F.col("buy") + F.col("sell"))
    return money(screens.activity_filter(rows, side="buy", breadth=20, total=100_000).select("broker", "ticker", "net"))


@query("p21_detail_filter", ", a AS (SELECT ticker, sum(net) AS net, sum(buy) AS buy, sum(sell) AS sell, count(*) AS days FROM n WHERE broker = 1 GROUP BY 1) SELECT ticker, CAST(net AS DOUBLE) AS net FROM a WHERE net >= 0 AND buy <= 5000000 AND days >= 3", "n")
def _(s, d):
    rows = net(s, d).where("broker = 1").groupBy("ticker").agg(*[F.sum(c).alias(c) for c in ("net", "buy", "sell")], F.count("*").alias("days"))
    return money(screens.detail_filter(rows, net=(0, None), buy=(None, 5_000_000), days=3).select("ticker", "net"))


@query("p10_threshold", "SELECT instrument, date FROM (SELECT instrument, date, lag(delta_pct) OVER (PARTITION BY instrument ORDER BY date) AS before FROM o) WHERE before >= 0", "o")
def _(s, d):
    before = tape.order_flow(days(s, d)).withColumn("before", F.lag("delta_pct").over(W.partitionBy("instrument").orderBy("date")))
    return before.where(screens.at_least("before", 0)).select("instrument", "date")


@query("c07_context_only", CTX + " SELECT instrument, date, round(greatest(0, least(1, ((greatest(-3.0::DOUBLE, least(3.0::DOUBLE, ctx_z)) + 3) / 6) * 0.6)), 6) AS score, CASE WHEN ctx_state = 'ACCUMULATION' AND ctx_z > 1 THEN 'WATCH_ACCUM' WHEN ctx_state = 'ACCUMULATION' THEN 'WATCH' WHEN ctx_state = 'DISTRIBUTION' AND ctx_z < -1 THEN 'STRONG_SELL' WHEN ctx_state = 'DISTRIBUTION' THEN 'SELL' ELSE 'NO_INTRADAY' END AS signal FROM x WHERE ctx_found", "o")
def _(s, d):
    return r6(screens.context_only(contexts(s, d).where("ctx_found")).select("instrument", "date", "score", "signal"), "score")


@query("c18_health", """
, q AS (SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS pv FROM f),
v AS (SELECT CASE WHEN coalesce(price, 0) <= 0 OR buyers = 0 OR sellers = 0 THEN 'CRITICAL' WHEN pv > 0 AND abs(CAST(price - pv AS DOUBLE) / pv) > 0.35 THEN 'WARNING' ELSE 'OK' END AS s FROM q)
SELECT count(*) AS checked, count(*) FILTER (s = 'WARNING') AS warning, count(*) FILTER (s = 'CRITICAL') AS critical, CASE WHEN count(*) FILTER (s = 'CRITICAL') > 0.1 * count(*) THEN 'FULL_REBUILD' WHEN count(*) FILTER (s = 'CRITICAL') > 0 THEN 'SELECTIVE_REPAIR' ELSE 'NONE' END AS action FROM v""", "f")  # fmt: skip
def _(s, d):
    q = flow(s, d).withColumn("prev_price", F.lag("price").over(W.partitionBy("ticker").orderBy("date")))
    return screens.health(scoring.quality_issues(q))


@query("k05_ordered_feed", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderdate DESC, coalesce(o_orderpriority, '9') DESC, o_orderkey DESC LIMIT 60")
def _(s, d):
    o = adapters.read(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return o.orderBy(F.desc("o_orderdate"), F.coalesce("o_orderpriority", F.lit("9")).desc(), F.desc("o_orderkey")).limit(60)


@query("k02_trend_ranking", ", k AS (SELECT *, row_number() OVER w - 1 AS i, CAST(sum(foreign_net) OVER w AS DOUBLE) AS cum FROM f WINDOW w AS (PARTITION BY ticker ORDER BY date)), a AS (SELECT ticker, arg_max(cum, i) AS total, regr_slope(cum, i) AS slope FROM k GROUP BY 1 HAVING count(*) >= 3), z AS (SELECT ticker, CASE WHEN total > 0 THEN 2 ELSE 0 END + CASE WHEN slope > 0 THEN 2 ELSE 0 END AS score, slope FROM a) SELECT ticker, score, row_number() OVER (ORDER BY score DESC, slope DESC, ticker) AS place FROM z", "f")
def _(s, d):
    t = flows.flow_trend(flow(s, d))
    # one row a ticker: a ranking of a few thousand
    return t.select("ticker", "score", F.row_number().over(W.orderBy(F.desc("score"), F.desc("slope"), "ticker")).alias("place"))


@query("w05c_rvol_fallback", CAL + """, e AS (SELECT a.instrument, a.date, a.day_index, a.vol, list({'i': b.day_index, 'v': b.vol} ORDER BY b.day_index DESC)[1:4] AS l
  FROM (SELECT * FROM d JOIN cal USING (date)) a LEFT JOIN (SELECT * FROM d JOIN cal USING (date)) b ON a.instrument = b.instrument AND b.day_index < a.day_index GROUP BY ALL)
SELECT instrument, date, round(CAST(vol AS DOUBLE) / nullif(list_avg([x.v FOR x IN l IF x.i IS NOT NULL AND day_index - x.i < 15]), 0), 6) AS rvol_5 FROM e""", "d")  # fmt: skip
def _(s, d):
    x = days(s, d).join(rolling.trading_calendar(ticks(s, d)), "date")
    return r6(screens.relative_volume_fallback(x, 5).select("instrument", "date", "rvol_5"), "rvol_5")
