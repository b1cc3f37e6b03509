"""Further queries: filters, joins, rankings, activity and feature rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio
from tapeloom.operators import activity, relational, rolling, scoring, tape
from tapeloom.plans.queries import CTX, HYBRID, LEVELS, REGIME, SMART, bars, contexts, days, flow, money, net, query, r6, regimes, signed, ticks
from tapeloom.sources import adapters
from tapeloom.storage import numbered


@query("p03_session_window", "SELECT instrument, count(*) AS n, sum(vol)::BIGINT AS vol FROM c WHERE CAST(bucket AS TIME) BETWEEN TIME '02:00:00' AND TIME '09:00:00' GROUP BY 1", "c")
def _(s, d):
    minute = F.hour("bucket") * 60 + F.minute("bucket")
    return bars(s, d).where(minute.between(120, 540)).groupBy("instrument").agg(F.count("*").alias("n"), F.sum("vol").alias("vol"))


@query("p03_session_until_now", """SELECT instrument, date, count(*) AS n, sum(vol)::BIGINT AS vol FROM c
WHERE bucket BETWEEN date + INTERVAL '2 hours' AND CASE WHEN date = DATE '2024-01-29' THEN TIMESTAMP '2024-01-29 05:20:00' ELSE date + INTERVAL '9 hours' END GROUP BY ALL""", "c")  # fmt: skip
def _(s, d):
    c = bars(s, d).withColumn("at", F.col("bucket").cast("timestamp"))
    inside = tape.in_session(F.col("at"), F.col("date"), F.lit("2024-01-29 05:20:00").cast("timestamp"))
    return c.where(inside).groupBy("instrument", "date").agg(F.count("*").alias("n"), F.sum("vol").alias("vol"))


@query("p07_any_window_passes", "SELECT ticker FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, foreign_net FROM f) GROUP BY 1 HAVING coalesce(sum(foreign_net) FILTER (k <= 2) > 0, false) OR coalesce(sum(foreign_net) FILTER (k <= 5) > 0, false)", "f")
def _(s, d):
    k = flow(s, d).withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date"))))
    sums = k.groupBy("ticker").agg(F.array(*[F.sum(F.when(F.col("k") <= w, F.col("foreign_net"))) for w in (2, 5)]).alias("w"))
    return sums.where(F.exists("w", lambda x: x > 0)).select("ticker")


LOOK = ", l AS (SELECT instrument, date, " + ", ".join(f"CAST(100 * sum(delta) OVER w{n} AS DOUBLE) / CAST(sum(vol) OVER w{n} AS DOUBLE) AS p{n}, sum(delta) OVER w{n} AS s{n}" for n in (2, 5, 10, 20)) + " FROM d WINDOW " + ", ".join(f"w{n} AS (PARTITION BY instrument ORDER BY date ROWS {n - 1} PRECEDING)" for n in (2, 5, 10, 20)) + ")"


def lookback(s, d):
    x = days(s, d)
    for n in activity.ORDER:
        w = W.partitionBy("instrument").orderBy("date").rowsBetween(-(n - 1), 0)
        x = x.withColumn(f"p{n}", ratio(100 * F.sum("delta").over(w), F.sum("vol").over(w))).withColumn(f"s{n}", F.sum("delta").over(w))
    return x


for _mode, _cond in {"2gt5": "p2 > p5", "10gt20": "p10 > p20", "ladderUp": "p2 >= p5 AND p5 >= p10 AND p10 >= p20", "allPos": "least(p2, p5, p10, p20) > 0", "allNeg": "greatest(p2, p5, p10, p20) < 0"}.items():

    @query(f"p09_trend_{_mode.lower()}", LOOK + f" SELECT instrument, date FROM l WHERE {_cond}", "d")
    def _(s, d, mode=_mode):
        return lookback(s, d).where(activity.relation({n: F.col(f"p{n}") for n in activity.ORDER}, mode)).select("instrument", "date")


@query("w21_trend_score", LOOK + " SELECT instrument, date, (sign(s2 / 2 - s5 / 5) + sign(s5 / 5 - s10 / 10) + sign(s10 / 10 - s20 / 20) + sign(s2))::INT AS score FROM l", "d")
def _(s, d):
    return lookback(s, d).select("instrument", "date", activity.trend_score({n: F.col(f"s{n}").cast("double") for n in activity.ORDER}).alias("score"))


@query("p12_symbol_list", "SELECT instrument, date, vol FROM d WHERE instrument IN ('click', 'view')", "d")
def _(s, d):
    return days(s, d).where(F.col("instrument").isin("click", "view")).select("instrument", "date", "vol")


@query("p16_thin_candles", "SELECT instrument, date, bool_or(trades < 2) AS thin FROM (SELECT *, row_number() OVER (PARTITION BY instrument, date ORDER BY bucket) AS k FROM c) WHERE k <= 10 GROUP BY ALL", "c")
def _(s, d):
    first = relational.top(bars(s, d), ["instrument", "date"], [F.asc("bucket")], 10)
    return first.groupBy("instrument", "date").agg(F.bool_or(F.col("trades") < 2).alias("thin"))


@query("a02_range_rollup", "SELECT instrument, sum(vol)::BIGINT AS vol, sum(delta)::BIGINT AS delta, max(CASE WHEN high > 100 THEN high ELSE close END) AS high, min(CASE WHEN low > 10 THEN low ELSE close END) AS low FROM c WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1", "c")
def _(s, d):
    c = bars(s, d).where(F.col("date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))
    high, low = F.when(F.col("high") > 100, F.col("high")).otherwise(F.col("close")), F.when(F.col("low") > 10, F.col("low")).otherwise(F.col("close"))
    return c.groupBy("instrument").agg(F.sum("vol").alias("vol"), F.sum("delta").alias("delta"), F.max(high).alias("high"), F.min(low).alias("low"))


@query("a05_first_and_last_nonzero", "SELECT instrument, date, arg_min(open, bucket) FILTER (open > 50) AS open, arg_max(close, bucket) FILTER (close > 50) AS close FROM c GROUP BY ALL", "c")
def _(s, d):
    some = lambda c: F.when(F.col(c) > 50, F.col(c))
    at = lambda c: F.when(F.col(c) > 50, F.col("bucket"))
    return bars(s, d).groupBy("instrument", "date").agg(F.min_by(some("open"), at("open")).alias("open"), F.max_by(some("close"), at("close")).alias("close"))


@query("a21_ownership", "SELECT c_custkey, count(o_orderkey) AS holdings, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total, coalesce(max(o_totalprice), 0) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    c, o = adapters.read(s, d, "customer"), adapters.read(s, d, "orders")
    # sums first, so the join carries one row a customer
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast(adapters.MONEY)).cast("double").alias("t"), F.max("o_totalprice").alias("m"))
    zero = lambda x, v: F.coalesce(x, F.lit(v))
    return c.select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", zero("n", 0).alias("holdings"), zero("t", 0.0).alias("total"), zero("m", 0.0).alias("largest"))


@query("a24_cvd_from_levels", "SELECT instrument, bucket, sum(bv - av)::BIGINT AS cvd FROM (" + LEVELS.format(half="0", rest="0") + ") GROUP BY ALL", "s")
def _(s, d):
    nested = tape.nested_candles(signed(s, d), "drop")
    return nested.select("instrument", "bucket", F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["bv"] - x["av"]).alias("cvd"))


@query("j02_left_join_detail", "SELECT o_orderkey, o_orderdate, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def _(s, d):
    o, c = adapters.read(s, d, "orders"), adapters.read(s, d, "customer")
    o = o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return o.join(c.where("c_acctbal > 0"), o.o_custkey == c.c_custkey, "left").select("o_orderkey", "o_orderdate", "c_mktsegment")


@query("j03_inner_join_dimension", "SELECT n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(s, d):
    sup, n, r = (adapters.read(s, d, t) for t in ("supplier", "nation", "region"))
    per = sup.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return per.join(n, per.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", "n")


@query("j07_as_of_global", "SELECT ticker, price FROM f WHERE date = (SELECT max(date) FROM f WHERE date <= DATE '1998-06-15')", "f")
def _(s, d):
    f = flow(s, d).where(F.col("date") <= F.lit("1998-06-15").cast("date"))
    return f.join(F.broadcast(f.agg(F.max("date").alias("date"))), "date").select("ticker", "price")  # one row


@query("j09_as_of_before", "SELECT ticker, price FROM f WHERE date = (SELECT max(date) FROM f WHERE date < DATE '1998-06-01')", "f")
def _(s, d):
    f = flow(s, d).where(F.col("date") < F.lit("1998-06-01").cast("date"))
    return f.join(F.broadcast(f.agg(F.max("date").alias("date"))), "date").select("ticker", "price")


@query("j10_previous_close", "SELECT instrument, date, coalesce(CASE WHEN lag(close) OVER w > 100 THEN lag(close) OVER w END, CASE WHEN lag(open) OVER w > 0 THEN lag(open) OVER w END, open) AS prev_close FROM d WINDOW w AS (PARTITION BY instrument ORDER BY date)", "d")
def _(s, d):
    w = W.partitionBy("instrument").orderBy("date")
    c, o = F.lag("close").over(w), F.lag("open").over(w)
    return days(s, d).select("instrument", "date", F.coalesce(F.when(c > 100, c), F.when(o > 0, o), F.col("open")).alias("prev_close"))


@query("j11_first_match", "SELECT p_brand, min(p_type) AS sector, arg_min(p_partkey, (p_type, p_partkey)) AS p_partkey FROM part GROUP BY 1")
def _(s, d):
    p = adapters.read(s, d, "part")
    return p.groupBy("p_brand").agg(F.min("p_type").alias("sector"), F.min_by("p_partkey", F.struct("p_type", "p_partkey")).alias("p_partkey"))


@query("j16_time_of_day", ", h AS (SELECT instrument, extract(hour FROM bucket)::INT AS hour, sum(vol) AS v FROM c GROUP BY ALL) SELECT c.instrument, bucket, CAST(c.vol AS DOUBLE) / CAST(h.v AS DOUBLE) AS share FROM c JOIN h ON h.instrument = c.instrument AND h.hour = extract(hour FROM bucket)", "c")
def _(s, d):
    c = bars(s, d).withColumn("hour", F.hour("bucket"))
    total = F.sum("vol").over(W.partitionBy("instrument", "hour"))  # the same rows: a window, not a self-join
    return c.select("instrument", "bucket", ratio(F.col("vol"), total).alias("share"))


@query("j17_enriched_screener", REGIME + ", a AS (SELECT ticker, state, date FROM rg QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) SELECT a.ticker, a.state, f.price, f.buyers FROM a LEFT JOIN f USING (ticker, date)", "f")
def _(s, d):
    last = relational.latest(regimes(s, d).select("ticker", "date", "state"), ["ticker"], "date")
    return last.join(flow(s, d), ["ticker", "date"], "left").select("ticker", "state", "price", "buyers")


@query("j17_screener_with_live", REGIME + """, a AS (SELECT ticker, state, date FROM rg QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
lv AS (SELECT p_brand AS ticker, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS price_last, count(*) AS freq FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey < 4 GROUP BY 1)
SELECT a.ticker, a.state, f.price, f.buyers, lv.price_last, lv.freq FROM a LEFT JOIN f USING (ticker, date) LEFT JOIN lv USING (ticker)""", "f")  # fmt: skip
def _(s, d):
    """State, flow features of its day and a live snapshot; tickers without trades of the live brokers keep nulls."""
    last = relational.latest(regimes(s, d).select("ticker", "date", "state"), ["ticker"], "date")
    li, part = adapters.read(s, d, "lineitem").where("l_suppkey < 4"), adapters.read(s, d, "part")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    live = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("ticker")).agg(F.max_by("l_extendedprice", at).alias("price_last"), F.count("*").alias("freq"))
    found = last.join(flow(s, d), ["ticker", "date"], "left").join(live, "ticker", "left")
    return found.select("ticker", "state", "price", "buyers", "price_last", "freq")


@query("w03_lags", SMART + " SELECT ticker, date, ret, lag(effort, 1) OVER w AS effort_1, lag(effort, 2) OVER w AS effort_2 FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date)", "f")
def _(s, d):
    w = W.partitionBy("ticker").orderBy("date")
    return rolling.smart_money(flow(s, d)).select("ticker", "date", "ret", F.lag("effort", 1).over(w).alias("effort_1"), F.lag("effort", 2).over(w).alias("effort_2"))


@query("w12_slope", "SELECT instrument, CASE WHEN count(*) < 3 THEN 0 ELSE round(regr_slope(vol, i), 6) END AS slope FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) AS i FROM d) GROUP BY 1", "d")
def _(s, d):
    i = days(s, d).withColumn("i", F.row_number().over(W.partitionBy("instrument").orderBy("date")))
    slope = F.regr_slope(F.col("vol").cast("double"), F.col("i").cast("double"))
    return i.groupBy("instrument").agg(F.when(F.count("*") < 3, 0.0).otherwise(F.round(slope, 6)).alias("slope"))


@query("w13_rank_trail", """
, r AS (SELECT instrument, bucket, row_number() OVER (PARTITION BY bucket ORDER BY vol DESC, instrument) AS rank FROM c QUALIFY rank <= 3),
i AS (SELECT *, epoch(bucket)::BIGINT // 3600 - row_number() OVER (PARTITION BY instrument ORDER BY bucket) AS isl FROM r)
SELECT instrument, bucket, rank, row_number() OVER w AS presence, lag(rank) OVER w - rank AS rank_delta FROM i WINDOW w AS (PARTITION BY instrument, isl ORDER BY bucket)""", "c")  # fmt: skip
def _(s, d):
    return activity.rank_trail(bars(s, d).select("instrument", "bucket", "vol"), "instrument", "bucket", "vol", 3).drop("vol")


@query("w23_momentum", """
, x AS (SELECT ticker, broker, date, CAST(buy AS DOUBLE) AS b, CAST(sell AS DOUBLE) AS s, CAST(net AS DOUBLE) / CAST(buy + sell AS DOUBLE) AS c, row_number() OVER w AS i, count(*) OVER (PARTITION BY ticker, broker) AS n FROM n WINDOW w AS (PARTITION BY ticker, broker ORDER BY date)),
a AS (SELECT ticker, broker, max(n) AS days, CAST(sum(CAST(b AS DECIMAL(18,2))) AS DOUBLE) AS b, CAST(sum(CAST(s AS DECIMAL(18,2))) AS DOUBLE) AS s,
  sum(c * CASE WHEN i = 1 THEN pow(1 - 2.0 / (n + 1), n - 1) ELSE 2.0 / (n + 1) * pow(1 - 2.0 / (n + 1), n - i) END) AS ema,
  CASE WHEN max(n) >= 3 THEN avg(c) FILTER (i > n - greatest(1, n // 3)) - avg(c) FILTER (i <= greatest(1, n // 3)) ELSE 0 END AS roc FROM x GROUP BY ALL)
SELECT ticker, broker, days::INT AS days, round(greatest(-100, least(100, 0.4 * ((100 - 100 / (1 + CASE WHEN s > 0 THEN b / s WHEN b > 0 THEN 10 ELSE 1 END) - 50) * 2) + 0.4 * ema * 100 + 0.2 * greatest(-100, least(100, roc * 100)))), 6) AS momentum FROM a""", "n")  # fmt: skip
def _(s, d):
    return r6(activity.momentum(net(s, d), ["ticker", "broker"]), "momentum")


@query("w24_calendar_streak", """
, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ix FROM (SELECT DISTINCT date FROM n)),
a AS (SELECT broker, ix, sign(sum(net))::INT AS s FROM n JOIN cal USING (date) GROUP BY broker, ix HAVING sum(net) <> 0),
k AS (SELECT *, row_number() OVER w AS k, first_value(s) OVER w AS f, first_value(ix) OVER w AS t FROM a WINDOW w AS (PARTITION BY broker ORDER BY ix DESC)),
r AS (SELECT *, min((s = f AND t - ix = k - 1)::INT) OVER (PARTITION BY broker ORDER BY ix DESC) AS run FROM k)
SELECT broker, (max(f) * sum(run))::BIGINT AS streak FROM r GROUP BY 1""", "n")  # fmt: skip
def _(s, d):
    n = net(s, d, ("broker", "date"))
    cal = n.select("date").distinct().withColumn("day_index", F.row_number().over(W.orderBy("date")) - 1)
    return activity.calendar_streak(n.select("broker", "date", "net"), cal, ["broker"])


@query("w25_growth_momentum", "SELECT instrument, date, round(100 * (close - coalesce(lag(close) OVER w, open)) / coalesce(lag(close) OVER w, open), 4) AS growth, round(100 * (close - coalesce(lag(close, 5) OVER w, lag(close, 4) OVER w, lag(close, 3) OVER w)) / coalesce(lag(close, 5) OVER w, lag(close, 4) OVER w, lag(close, 3) OVER w), 4) AS mom_5 FROM d WINDOW w AS (PARTITION BY instrument ORDER BY date)", "d")
def _(s, d):
    w = W.partitionBy("instrument").orderBy("date")
    before = F.coalesce(F.lag("close").over(w), F.col("open"))
    past = F.coalesce(*[F.lag("close", k).over(w) for k in (5, 4, 3)])
    pct = lambda b: F.round(100 * (F.col("close") - b) / b, 4)
    return days(s, d).select("instrument", "date", pct(before).alias("growth"), pct(past).alias("mom_5"))


@query("r02_effort_override", SMART + ", z AS (SELECT *, coalesce(CASE WHEN count(*) OVER w >= 2 THEN (effort - avg(effort) OVER w) / nullif(stddev_pop(effort) OVER w, 0) END, 0) AS z FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)) SELECT ticker, date, round(coalesce(lag(z) OVER v, z), 6) AS effort_z, coalesce(lag(z) OVER v, z) < -0.3 AND lag(z) OVER v IS NOT NULL AND coalesce(lag(z, 2) OVER v > 0.3, true) AS declining FROM z WINDOW v AS (PARTITION BY ticker ORDER BY date)", "f")
def _(s, d):
    z = rolling.rolling_z(rolling.smart_money(flow(s, d)), ("effort",), (20,))
    w = W.partitionBy("ticker").orderBy("date")
    e1, e2 = F.lag("z_effort_20", 1).over(w), F.lag("z_effort_20", 2).over(w)
    ez = F.coalesce(e1, F.col("z_effort_20"))
    return z.select("ticker", "date", F.round(ez, 6).alias("effort_z"), ((ez < -0.3) & e1.isNotNull() & F.coalesce(e2 > 0.3, F.lit(True))).alias("declining"))


@query("r06_on_demand_features", """
, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) AS u, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS w FROM d),
a AS (SELECT instrument, count(*) AS days, avg(vol) AS avg_vol, 100 * (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) AS price_change, avg(CAST(delta * 100 AS DOUBLE) / vol) AS avg_delta_pct,
  sum(delta) FILTER (w <= 5)::BIGINT AS recent, sum(delta) FILTER (u <= 5)::BIGINT AS early FROM k GROUP BY 1)
SELECT instrument, days, round(avg_vol, 6) AS avg_vol, round(price_change, 6) AS price_change, round(avg_delta_pct, 6) AS avg_delta_pct, recent, early, round(price_change / (avg_vol / 1000000), 4) AS elasticity,
  CASE WHEN recent > early * 1.5 AND recent > 0 THEN 'ACCUMULATION' WHEN recent < early * 0.5 AND recent < 0 THEN 'DISTRIBUTION' WHEN recent > 0 AND price_change > 2 THEN 'READY_MARKUP' WHEN recent < 0 AND price_change < -2 THEN 'POTENTIAL_TOP' ELSE 'NEUTRAL' END AS state FROM a""", "d")  # fmt: skip
def _(s, d):
    f = r6(activity.on_demand_features(days(s, d)), "avg_vol", "price_change", "avg_delta_pct").withColumn("elasticity", F.round("elasticity", 4))
    return f


@query("r09_vwap_position", "SELECT instrument, date, round(100 * (close - vwap) / vwap, 4) AS position FROM (SELECT instrument, date, arg_max(close, bucket) AS close, CAST(sum(CAST(close AS DECIMAL(18,2)) * vol) AS DOUBLE) / CAST(sum(vol) AS DOUBLE) AS vwap FROM c GROUP BY ALL)", "c")
def _(s, d):
    v = ratio(F.sum(F.col("close").cast(adapters.MONEY) * F.col("vol")), F.sum("vol"))
    g = bars(s, d).groupBy("instrument", "date").agg(F.max_by("close", "bucket").alias("close"), v.alias("vwap"))
    return g.select("instrument", "date", F.round(100 * (F.col("close") - F.col("vwap")) / F.col("vwap"), 4).alias("position"))


@query("c03_divergence_counts", HYBRID + " SELECT factor, coalesce(div_type, 'NONE') AS div_type, count(*) AS n FROM h2 GROUP BY ALL", "o")
def _(s, d):
    return scoring.hybrid_daily(contexts(s, d)).groupBy("factor", F.coalesce("div_type", F.lit("NONE")).alias("div_type")).agg(F.count("*").alias("n"))


@query("c09_sparse_override", "SELECT instrument, date, CASE WHEN candles < 12 THEN 0 ELSE delta_pct END AS d, CASE WHEN candles < 12 THEN 'daily_stats' ELSE 'candles' END AS source FROM o", "o")
def _(s, d):
    thin = F.col("candles") < 12
    o = tape.order_flow(days(s, d))
    return o.select("instrument", "date", F.when(thin, 0.0).otherwise(F.col("delta_pct")).alias("d"), F.when(thin, "daily_stats").otherwise("candles").alias("source"))


def hot_inputs(s, d):
    """The inputs of the hot score by instrument and day; the slopes are changes from the day before, divergence is that of the hybrid score."""
    w = W.partitionBy("instrument").orderBy("date")
    o = contexts(s, d).withColumns({"chg": F.col("price_pct"), "value": F.col("vol"), "pressure": 50 + F.col("delta_pct") / 2, "cvd": F.col("delta"), "p_slope": F.col("delta_pct") - F.lag("delta_pct").over(w), "c_slope": F.col("delta") - F.lag("delta").over(w)})
    factor = scoring.divergence_factor(F.col("ctx_state"), F.col("delta_pct"), F.col("ctx_z"))
    divergent = F.coalesce(F.col("ctx_found") & (factor <= 0.7), F.lit(False))
    return o.withColumns({"bss": 50 + F.col("delta_pct") / 2, "ats": 50 - F.col("price_pct") / 10, "divergent": divergent})


def _mid(c: str) -> str:
    n = "count(*) OVER (PARTITION BY date)"
    return f"CASE WHEN {n} <= 1 THEN 0.5::DOUBLE ELSE (rank() OVER (PARTITION BY date ORDER BY {c}) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY date, {c})) / {n} END"


@query("c11_hot_score", CTX + f"""
, i AS (SELECT *, coalesce(price_pct, 0) AS chg, coalesce(50 + delta_pct / 2, 50) AS prs, delta_pct - lag(delta_pct) OVER w AS ps, CAST(delta - lag(delta) OVER w AS DOUBLE) AS cs,
  coalesce(ctx_found AND ((ctx_state = 'DISTRIBUTION' AND (delta_pct > 5 OR (delta_pct > 0 AND ctx_z < -0.5))) OR (ctx_state = 'ACCUMULATION' AND delta_pct < -5)), false) AS dv FROM x WINDOW w AS (PARTITION BY instrument ORDER BY date)),
k AS (SELECT *, {_mid("chg")} AS m, {_mid("vol")} AS v, {_mid("prs")} AS p, {_mid("delta")} AS c, greatest(0::DOUBLE, least(1::DOUBLE, (coalesce(ps, 0) + 2) / 4)) AS pf, greatest(0::DOUBLE, least(1::DOUBLE, (coalesce(cs, 0) + 2) / 4)) AS cf,
  coalesce((50 + delta_pct / 2) / 100, 0.5) AS b, coalesce((50 - price_pct / 10) / 100, 0.5) AS a, (dv OR (abs(chg) > 1.5 AND abs(delta) > 50 AND sign(chg) * sign(delta) < 0))::INT AS dg,
  (abs(chg) > avg(abs(chg)) OVER (PARTITION BY date) + 2 * coalesce(nullif(stddev_pop(abs(chg)) OVER (PARTITION BY date), 0), 1))::INT AS ex FROM i),
z AS (SELECT *, floor(100 * greatest(0::DOUBLE, least(1::DOUBLE, 0.1 * m + 0.1 * v + 0.2 * p + 0.1 * pf + 0.2 * c + 0.1 * cf + 0.1 * b + 0.1 * a - 0.25 * dg - 0.1 * ex)) + 0.5) AS sc FROM k),
h AS (SELECT *, CASE WHEN sc > 70 AND NOT (p > 0.6 AND (b > 0.6 OR a > 0.6) AND dg = 0) THEN least(sc, 69) ELSE sc END AS hot,
  [q.n FOR q IN list_sort(list_filter([{{'w': -m, 'n': 'M'}}, {{'w': -v, 'n': 'V'}}, {{'w': -p, 'n': 'P'}}, {{'w': -c, 'n': 'C'}}, {{'w': -b, 'n': 'B'}}, {{'w': -a, 'n': 'O'}}], lambda q: q.w < -0.6::DOUBLE))] AS why FROM z)
SELECT instrument, date, hot, CASE WHEN hot >= 70 THEN 'Strong Continuation' WHEN hot >= 50 THEN 'Watch' ELSE 'Cooling' END AS stage,
  array_to_string(list_concat(why, ['NEUTRAL', 'NEUTRAL'][1:greatest(0, 2 - len(why))]), ',') AS reasons FROM h""", "o")  # fmt: skip
def _(s, d):
    return activity.hot_score(hot_inputs(s, d), ["date"]).select("instrument", "date", "hot", "stage", F.array_join("reasons", ",").alias("reasons"))


@query("k01_all_sorted_scores", HYBRID + " SELECT instrument, date, round(score, 6) AS score, row_number() OVER (ORDER BY coalesce(score, 0) DESC, instrument, date) AS place FROM h2", "o")
def _(s, d):
    h = scoring.hybrid_daily(contexts(s, d)).withColumn("_sc", -F.coalesce("score", F.lit(0.0)))
    placed = numbered(h.select("instrument", "date", "score", "_sc"), ["_sc", "instrument", "date"], "place")
    return placed.orderBy("place").select("instrument", "date", F.round("score", 6).alias("score"), (F.col("place") + 1).alias("place"))


@query("k06_latest_rows", "SELECT instrument, date, close FROM d QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY date DESC) <= 7", "d")
def _(s, d):
    return relational.top(days(s, d), ["instrument"], [F.desc("date")], 7).select("instrument", "date", "close")


@query("u01_key_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier")
def _(s, d):
    o, c, u = (adapters.read(s, d, t) for t in ("orders", "customer", "supplier"))
    return o.select(F.col("o_custkey").alias("k")).union(c.select("c_custkey")).union(u.select("s_suppkey")).distinct()


@query("u03_union_without_duplicates", "SELECT date, instrument, 'db' AS source FROM d WHERE candles >= 12 UNION ALL SELECT date, instrument, 'cache' FROM d WHERE vol > 500 AND (instrument, date) NOT IN (SELECT (instrument, date) FROM d WHERE candles >= 12)", "d")
def _(s, d):
    x = days(s, d)
    db, cache = x.where("candles >= 12"), x.where("vol > 500")
    rest = cache.join(db, ["instrument", "date"], "left_anti")
    return db.select("date", "instrument", F.lit("db").alias("source")).unionByName(rest.select("date", "instrument", F.lit("cache").alias("source")))


@query("u07_expected_minus_present", "SELECT DISTINCT date FROM t EXCEPT SELECT date FROM d WHERE instrument = 'view' AND candles >= 12", "d")
def _(s, d):
    return ticks(s, d).select("date").distinct().exceptAll(days(s, d).where("instrument = 'view' AND candles >= 12").select("date"))


@query("t12_level_history", "SELECT instrument, bucket, p, bv >= av AS buy_side, CAST(bv AS DOUBLE) / nullif(CAST(bv + av AS DOUBLE), 0) AS balance FROM (" + LEVELS.format(half="qty // 2", rest="qty - qty // 2") + ")", "s")
def _(s, d):
    lv = tape.levels(signed(s, d))
    return lv.select("instrument", "bucket", "p", (F.col("bv") >= F.col("av")).alias("buy_side"), ratio(F.col("bv"), F.col("bv") + F.col("av")).alias("balance"))


@query("r07_flow_features", """
, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS u, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS w FROM f),
a AS (SELECT ticker, count(*) AS days, avg(CAST(total_value AS DOUBLE)) AS v, arg_min(price, date) AS a, arg_max(price, date) AS z, avg(price) FILTER (price > 0) AS m, CAST(sum(smart_net) AS DOUBLE) AS t, CAST(max(abs(smart_net)) AS DOUBLE) AS x,
  CAST(sum(smart_net) FILTER (w <= 5) AS DOUBLE) AS r, CAST(sum(smart_net) FILTER (u <= 5) AS DOUBLE) AS e FROM k GROUP BY 1),
c AS (SELECT *, coalesce(100 * CAST(z - a AS DOUBLE) / nullif(greatest(a, 0), 0), 0) AS p FROM a)
SELECT ticker, days, round(greatest(-3, least(3, v / 5e9 * 3)), 6) AS effort, round(greatest(-3, least(3, p / 10 * 3)), 6) AS response, round(greatest(-3, least(3, t / days / coalesce(nullif(x, 0), 1) * 3)), 6) AS quality,
  round(greatest(-3, least(3, coalesce((z - m) * 100 / m, 0) / 5 * 3)), 6) AS vwap, round(greatest(-3, least(3, coalesce(p / nullif(t / 1000000, 0), 0) / 5 * 3)), 6) AS elasticity,
  CASE WHEN r > 0 AND r > e * 1.2 THEN 'ACCUMULATION' WHEN r < 0 AND r < e * 0.8 THEN 'DISTRIBUTION' WHEN r > 0 AND p > 3 THEN 'READY_MARKUP' WHEN r < 0 AND p < -3 THEN 'POTENTIAL_TOP' ELSE 'NEUTRAL' END AS state FROM c WHERE days >= 5""", "f")  # fmt: skip
def _(s, d):
    x = activity.flow_features(flow(s, d)).where("days >= 5")
    return r6(x, "effort", "response", "quality", "vwap", "elasticity")
