"""Queries on two-level scans: the same rows as their one-level forms, without a key's whole history in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import flows, rolling, scans
from tapeloom.plans import screens  # noqa: F401  its queries are named below
from tapeloom.plans.queries import RANKED, SQL, bars, days, flow, money, net, query, r6, ticks
from tapeloom.sources import adapters
from tapeloom.storage import numbered


@query("w07_rsi_all_dates", """
, v AS (SELECT instrument, date, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS x FROM d WINDOW w AS (PARTITION BY instrument ORDER BY date)),
h AS (SELECT a.instrument, a.date, list(b.x ORDER BY b.i) AS xs FROM v a LEFT JOIN v b ON a.instrument = b.instrument AND b.i BETWEEN 1 AND a.i GROUP BY ALL),
g AS (SELECT *, list_reduce(list_prepend(list_sum([greatest(q, 0) FOR q IN xs[1:14]]) / 14, [greatest(q, 0) FOR q IN xs[15:]]), lambda a, q: (a * 13 + q) / 14) AS up,
  list_reduce(list_prepend(list_sum([greatest(-q, 0) FOR q IN xs[1:14]]) / 14, [greatest(-q, 0) FOR q IN xs[15:]]), lambda a, q: (a * 13 + q) / 14) AS down FROM h)
SELECT instrument, date, CASE WHEN len(xs) >= 14 AND xs[1] IS NOT NULL THEN round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) END AS rsi FROM g""", "d")  # fmt: skip
def _(s, d):
    return r6(scans.rsi_all(days(s, d), unit="week"), "rsi")


@query("j08_as_of_two_level", SQL["j08_as_of_strict"])
def _(s, d):
    o = adapters.read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    past = o.groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("before"))
    found = scans.as_of_parts(o.drop("o_totalprice"), past, "o_custkey", "o_orderdate", "year", strict=True)
    return found.select("o_orderkey", "o_custkey", "o_orderdate", "before")


@query("t14_cvd_two_level", SQL["t14_running_cvd"])
def _(s, d):
    found = scans.running_sum(bars(s, d), ["instrument"], ["bucket"], F.to_date("bucket"), F.col("delta"), "cvd")
    return found.select("instrument", "bucket", "cvd")


@query("w10_cumulative_two_level", SQL["w10_cumulative_net"])
def _(s, d):
    found = scans.running_sum(net(s, d), ["ticker", "broker"], ["date"], F.date_trunc("year", "date"), F.col("net"), "cum_net")
    return money(found.select("ticker", "broker", "date", "cum_net"))


@query("w15_carried_two_level", SQL["w15_carried_averages"])
def _(s, d):
    points = rolling.average_grid(ticks(s, d))
    found = scans.last_known(points, ["instrument"], ["bucket"], F.to_date("bucket"), F.col("avg"), "known")
    return found.select("instrument", "bucket", F.round("known", 4).alias("avg"))


@query("w16_mid_rank_distributed", SQL["w16_mid_rank"])
def _(s, d):
    r = scans.value_ranks(days(s, d).select("instrument", "date", "vol"), ["date"], "vol")
    return r.select("instrument", "date", scans.mid_rank_of(F.col("below"), F.col("equal"), F.col("n")).alias("p"))


@query("w17_average_rank_distributed", SQL["w17_average_rank"])
def _(s, d):
    r = scans.value_ranks(days(s, d).select("instrument", "date", "vol"), ["date"], "vol")
    return r.select("instrument", "date", scans.average_rank_of(F.col("below"), F.col("equal"), F.col("n")).alias("p"))


@query("w17_candle_rank_distributed", f"SELECT instrument, bucket, {RANKED.replace('PARTITION BY date ', '')} + (count(*) OVER (PARTITION BY vol) - 1) / 2.0) / (count(*) OVER () - 1) AS p FROM c", "c")
def _(s, d):
    """One ranking of all candles: the case that a window would give to one task."""
    r = scans.value_ranks(bars(s, d).select("instrument", "bucket", "vol"), [], "vol")
    return r.select("instrument", "bucket", scans.average_rank_of(F.col("below"), F.col("equal"), F.col("n")).alias("p"))


@query("k02_places_distributed", SQL["k02_trend_ranking"])
def _(s, d):
    t = flows.flow_trend(flow(s, d)).withColumns({"_s": -F.col("score"), "_l": -F.col("slope")})
    return numbered(t, ["_s", "_l", "ticker"], "place").select("ticker", "score", (F.col("place") + 1).alias("place"))
