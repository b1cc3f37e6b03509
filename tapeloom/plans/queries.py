"""Named queries over the generated tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio
from tapeloom.operators import flows, relational, rolling, scoring, tape
from tapeloom.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions of the oracles, by name, in the order in which they build on each other.
PARTS = {
    "t": r"""SELECT event_type AS instrument, ts, event_id AS seq, value AS price, qty, CAST(ts AS DATE) AS date, date_trunc('hour', ts) AS bucket
             FROM (SELECT *, TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS qty FROM events) WHERE value > 0 AND qty > 0""",
    "s": """SELECT *, coalesce(sign(price - lag(price) OVER (PARTITION BY instrument, bucket ORDER BY ts, seq)), 0)::INT AS sign FROM t""",
    "c": """SELECT instrument, date, bucket, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
            sum(qty)::BIGINT AS vol, sum(qty * sign)::BIGINT AS delta, count(*) AS trades FROM s GROUP BY ALL""",
    "d": """SELECT instrument, date, arg_min(open, bucket) AS open, arg_max(close, bucket) AS close, max(high) AS high, min(low) AS low,
            sum(vol)::BIGINT AS vol, sum(delta)::BIGINT AS delta, count(*) AS candles, min(bucket) AS first_bucket, max(bucket) AS last_bucket FROM c GROUP BY ALL""",
    "o": """SELECT *, abs(delta_pct) / (1 + abs(price_pct)) AS absorption FROM (SELECT *, CAST(delta * 100 AS DOUBLE) / nullif(CAST(vol AS DOUBLE), 0) AS delta_pct,
            (close - open) * 100 / nullif(open, 0) AS price_pct FROM d)""",
    "bt": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_brand AS ticker, l_suppkey AS broker, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
             CAST(l_extendedprice AS DECIMAL(18,2)) AS value, CAST(l_quantity AS BIGINT) AS lots FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "b": """SELECT s_suppkey AS broker, CASE n_regionkey WHEN 0 THEN 'Retail' WHEN 1 THEN 'Foreign Fund' WHEN 2 THEN 'Local Fund' WHEN 3 THEN 'Retail Online' ELSE 'Foreign Bank' END AS category,
            CASE WHEN n_regionkey IN (1, 3) THEN 'Asing' ELSE 'Lokal' END AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "g": """SELECT bt.*, CASE WHEN type = 'Asing' OR lower(category) LIKE '%foreign%' THEN 'foreign' WHEN lower(category) LIKE '%retail%' THEN 'retail' ELSE 'local' END AS grp,
            CASE WHEN side = 'buy' THEN value ELSE -value END AS sv FROM bt LEFT JOIN b USING (broker)""",
    "f": """SELECT date, ticker, coalesce(sum(sv) FILTER (grp = 'foreign'), 0) AS foreign_net, coalesce(sum(sv) FILTER (grp = 'local'), 0) AS local_net,
            coalesce(sum(sv) FILTER (grp = 'retail'), 0) AS retail_net, coalesce(sum(sv) FILTER (grp <> 'retail'), 0) AS smart_net, sum(value) AS total_value, sum(lots)::BIGINT AS total_lots,
            count(DISTINCT broker) FILTER (side = 'buy') AS buyers, count(DISTINCT broker) FILTER (side = 'sell') AS sellers,
            CAST(floor(CAST(sum(value) AS DOUBLE) / CAST(sum(lots) AS DOUBLE)) AS BIGINT) AS price FROM g GROUP BY ALL""",
    "n": """SELECT ticker, broker, date, sum(CASE WHEN side = 'buy' THEN value ELSE 0 END) AS buy, sum(CASE WHEN side = 'sell' THEN value ELSE 0 END) AS sell,
            sum(CASE WHEN side = 'buy' THEN value ELSE -value END) AS net, sum(CASE WHEN side = 'buy' THEN lots ELSE -lots END)::BIGINT AS net_lots FROM bt GROUP BY ALL""",
}
NEEDS = {"s": ["t"], "c": ["s"], "d": ["c"], "o": ["d"], "g": ["bt", "b"], "f": ["g"], "n": ["bt"]}


def with_parts(body: str, *names: str) -> str:
    found: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in found:
            found.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({PARTS[n]})" for n in found) + " " + body


def query(name: str, sql: str | None = None, *parts: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_parts(sql, *parts) if parts else sql
        return f

    return keep


def ticks(spark, d) -> DataFrame:
    return tape.bucketed(tape.valid(adapters.ticks(spark, d)))


def signed(spark, d, mode: str = "minute_tick") -> DataFrame:
    return tape.signed(ticks(spark, d), mode)


def bars(spark, d) -> DataFrame:
    return tape.candles(signed(spark, d))


def days(spark, d) -> DataFrame:
    return tape.day_rollup(bars(spark, d))


def flow(spark, d, variant: str = "flow") -> DataFrame:
    return flows.daily_flow(adapters.broker_trades(spark, d), adapters.brokers(spark, d), variant)


def net(spark, d, keys=("ticker", "broker", "date")) -> DataFrame:
    return flows.broker_net(adapters.broker_trades(spark, d), keys)


def money(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for output."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- tape ----


@query("p01_valid_trades", "SELECT instrument, count(*) AS n, sum(qty)::BIGINT AS qty FROM t GROUP BY 1", "t")
def _(s, d):
    return ticks(s, d).groupBy("instrument").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("t01_candles", "SELECT * FROM c", "c")
def _(s, d):
    return bars(s, d)


LEVELS = """SELECT instrument, bucket, price AS p,
  sum(CASE WHEN sign > 0 THEN qty WHEN sign < 0 THEN 0 ELSE {half} END)::BIGINT AS bv, sum(CASE WHEN sign < 0 THEN qty WHEN sign > 0 THEN 0 ELSE {rest} END)::BIGINT AS av FROM s GROUP BY ALL"""


@query("t01_levels_split", LEVELS.format(half="qty // 2", rest="qty - qty // 2"), "s")
def _(s, d):
    return tape.levels(signed(s, d))


@query("t02_levels_drop", LEVELS.format(half="0", rest="0"), "s")
def _(s, d):
    return tape.levels(signed(s, d), "drop")


DAY_SUMMARY = """
, tl AS (SELECT *, sum(value) OVER w AS cum_value, coalesce((close - day_open) * 100 / nullif(day_open, 0), 0) AS momentum,
           (coalesce(CAST(delta AS DOUBLE) / vol, 0) + 1) * 50 - 50 AS x
         FROM (SELECT *, first(open) OVER (PARTITION BY instrument, date ORDER BY bucket) AS day_open, vol * CAST(close AS DECIMAL(18,2)) * 100 AS value FROM c)
         WINDOW w AS (PARTITION BY instrument, date ORDER BY bucket)),
q AS (SELECT *, CASE WHEN x >= 0 AND momentum >= 0 THEN 1 WHEN x < 0 AND momentum >= 0 THEN 2 WHEN x < 0 THEN 3 ELSE 4 END AS q FROM tl),
a AS (SELECT instrument, date, arg_min(open, bucket) AS open, arg_max(close, bucket) AS close, max(high) AS high, min(low) AS low, sum(vol)::BIGINT AS vol, sum(trades)::BIGINT AS freq,
        sum(delta)::BIGINT AS net_vol, CAST(max(cum_value) AS DOUBLE) AS val, arg_max(momentum, bucket) AS momentum, count(*) FILTER (q = 1) AS q1, count(*) FILTER (q = 2) AS q2,
        count(*) FILTER (q = 3) AS q3, count(*) FILTER (q = 4) AS q4, coalesce(sum(vol) FILTER (q = 4), 0)::BIGINT AS q4_vol FROM q GROUP BY ALL)
SELECT *, CAST(net_vol AS DOUBLE) / vol AS money_flow, CAST(q4 AS DOUBLE) / (q1 + q2 + q3 + q4) AS q4_ratio,
  round(CAST(q4 AS DOUBLE) / (q1 + q2 + q3 + q4) * (CAST(q4_vol AS DOUBLE) / vol) * greatest(CAST(net_vol AS DOUBLE) / vol, 0), 6) AS hidden_acc FROM a"""


@query("t03_day_summary", DAY_SUMMARY, "c")
def _(s, d):
    return r6(tape.day_summary(bars(s, d)), "hidden_acc")


@query("t04_day_tick_carry", """
, m AS (SELECT *, nullif(sign(price - lag(price) OVER w), 0) AS m FROM t WINDOW w AS (PARTITION BY instrument, date ORDER BY ts, seq)),
x AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY instrument, date ORDER BY ts, seq), 0)::INT AS sgn FROM m)
SELECT instrument, date, sum(qty * sgn)::BIGINT AS delta FROM x GROUP BY ALL""", "t")  # fmt: skip
def _(s, d):
    return signed(s, d, "day_tick_carry").groupBy("instrument", "date").agg(F.sum(F.col("qty") * F.col("sign")).alias("delta"))


@query("t07_realtime_signal", """
, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, seq DESC) AS k FROM t),
u AS (SELECT *, price > lag(price) OVER (PARTITION BY instrument ORDER BY ts, seq) AS up FROM k WHERE k <= 50),
a AS (SELECT instrument, sum(qty)::BIGINT AS vol, coalesce(sum(qty) FILTER (up), 0)::BIGINT AS up_vol, arg_min(price, ts) AS first_price, arg_max(price, ts) AS last_price, count(*) AS n FROM u GROUP BY 1)
SELECT *, CAST(up_vol AS DOUBLE) / vol AS haka_ratio, greatest(-0.05, least(0.05, (last_price - first_price) / first_price)) / 0.05 AS momentum,
  0.6 * (CAST(up_vol AS DOUBLE) / vol) AS fused, CASE WHEN 0.6 * (CAST(up_vol AS DOUBLE) / vol) > 0.2 THEN 'BUY' ELSE 'NEUTRAL' END AS side FROM a""", "t")  # fmt: skip
def _(s, d):
    return tape.realtime_signal(ticks(s, d))


@query("t07_recent_uptick", "SELECT instrument, date, coalesce(sum(qty) FILTER (up), 0)::BIGINT AS bought FROM (SELECT *, price > lag(price) OVER (PARTITION BY instrument, date ORDER BY ts, seq) AS up FROM t) GROUP BY ALL", "t")
def _(s, d):
    return signed(s, d, "recent_uptick").groupBy("instrument", "date").agg(F.sum(F.col("qty") * F.col("sign")).alias("bought"))


@query("t14_running_cvd", "SELECT instrument, bucket, sum(delta) OVER (PARTITION BY instrument ORDER BY bucket)::BIGINT AS cvd FROM c", "c")
def _(s, d):
    w = W.partitionBy("instrument").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return bars(s, d).select("instrument", "bucket", F.sum("delta").over(w).alias("cvd"))


@query("t15_cvd_vs_open", "SELECT instrument, bucket, sum(qty * sign(price - o))::BIGINT AS delta FROM (SELECT *, first_value(price) OVER (PARTITION BY instrument, bucket ORDER BY ts, seq) AS o FROM t) GROUP BY ALL", "t")
def _(s, d):
    return signed(s, d, "vs_open").groupBy("instrument", "bucket").agg(F.sum(F.col("qty") * F.col("sign")).alias("delta"))


@query("t16_top_by_value", "SELECT instrument, date, CAST(sum(qty * CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS value FROM t GROUP BY ALL ORDER BY value DESC, instrument, date LIMIT 50", "t")
def _(s, d):
    v = ticks(s, d).groupBy("instrument", "date").agg(F.sum(F.col("qty") * F.col("price").cast(adapters.MONEY)).cast("double").alias("value"))
    return v.orderBy(F.desc("value"), "instrument", "date").limit(50)


@query("t18_value_area", """
, l AS (SELECT instrument, bucket, p, bv + av AS v FROM (""" + LEVELS.format(half="qty // 2", rest="qty - qty // 2") + """)),
x AS (SELECT *, sum(v) OVER (PARTITION BY instrument, bucket) AS total, coalesce(sum(v) OVER (PARTITION BY instrument, bucket ORDER BY v DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT instrument, bucket, first(p ORDER BY v DESC, p) AS poc, min(p) FILTER (before < 0.7 * total) AS val, max(p) FILTER (before < 0.7 * total) AS vah FROM x GROUP BY ALL""", "s")  # fmt: skip
def _(s, d):
    return tape.value_area(tape.levels(signed(s, d)))


@query("t19_order_flow", "SELECT instrument, date, open, close, high, low, vol, delta, delta_pct, price_pct, absorption, CASE WHEN delta_pct >= 0 AND price_pct >= 0 THEN 'Q1' WHEN delta_pct < 0 AND price_pct >= 0 THEN 'Q2' WHEN delta_pct < 0 THEN 'Q3' ELSE 'Q4' END AS quadrant FROM o", "o")
def _(s, d):
    return tape.order_flow(days(s, d)).select("instrument", "date", "open", "close", "high", "low", "vol", "delta", "delta_pct", "price_pct", "absorption", "quadrant")


# ---- candle aggregates ----


@query("a01_day_rollup", "SELECT * FROM d", "d")
def _(s, d):
    return days(s, d)


@query("a03_last_close", "SELECT instrument, arg_max(close, bucket) AS close, max(bucket) AS last_bucket FROM c GROUP BY 1", "c")
def _(s, d):
    return bars(s, d).groupBy("instrument").agg(F.max_by("close", "bucket").alias("close"), F.max("bucket").alias("last_bucket"))


@query("a07_window_sums", """
, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS k FROM d)
SELECT instrument, sum(delta) FILTER (k <= 5)::BIGINT AS delta_5, sum(vol) FILTER (k <= 5)::BIGINT AS vol_5, sum(delta) FILTER (k <= 10)::BIGINT AS delta_10, sum(vol) FILTER (k <= 10)::BIGINT AS vol_10,
  CAST(100 * sum(delta) FILTER (k <= 5) AS DOUBLE) / CAST(sum(vol) FILTER (k <= 5) AS DOUBLE) AS cvd_pct_5 FROM k GROUP BY 1""", "d")  # fmt: skip
def _(s, d):
    k = days(s, d).withColumn("k", F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("date"))))
    part = lambda c, n: F.sum(F.when(F.col("k") <= n, F.col(c)))
    out = k.groupBy("instrument").agg(*[part(c, n).alias(f"{c}_{n}") for n in (5, 10) for c in ("delta", "vol")])
    return out.withColumn("cvd_pct_5", ratio(100 * F.col("delta_5"), F.col("vol_5")))


@query("a16_coverage", "SELECT date, count(DISTINCT instrument) AS instruments, count(*) AS candles, min(bucket) AS first_bucket, max(bucket) AS last_bucket FROM c GROUP BY 1", "c")
def _(s, d):
    return bars(s, d).groupBy("date").agg(F.count_distinct("instrument").alias("instruments"), F.count("*").alias("candles"), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))


@query("a17_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 10")
def _(s, d):
    n = adapters.read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    return n.orderBy(F.desc("n"), "l_orderkey", "l_linenumber").limit(10)


@query("a19_rollup_day_candles", "SELECT instrument, date_trunc('day', bucket) AS bucket, arg_min(open, bucket) AS open, max(high) AS high, min(low) AS low, arg_max(close, bucket) AS close, sum(vol)::BIGINT AS vol, sum(delta)::BIGINT AS delta FROM c GROUP BY instrument, date_trunc('day', bucket)", "c")
def _(s, d):
    return tape.rolled(bars(s, d), "day")


@query("a19_rollup_day_levels", "SELECT instrument, date_trunc('day', bucket) AS bucket, p, sum(bv)::BIGINT AS bv, sum(av)::BIGINT AS av FROM (" + LEVELS.format(half="qty // 2", rest="qty - qty // 2") + ") GROUP BY instrument, date_trunc('day', bucket), p", "s")
def _(s, d):
    return tape.rolled_levels(tape.levels(signed(s, d)), "day")


@query("a22_vwap", "SELECT instrument, date, round(CAST(sum(CAST(high + low + close AS DECIMAL(18,2)) * vol) AS DOUBLE) / 3 / CAST(sum(vol) AS DOUBLE), 6) AS vwap FROM c GROUP BY ALL", "c")
def _(s, d):
    typical = (F.col("high") + F.col("low") + F.col("close")).cast(adapters.MONEY)
    return bars(s, d).groupBy("instrument", "date").agg(F.round(F.sum(typical * F.col("vol")).cast("double") / 3 / F.sum("vol").cast("double"), 6).alias("vwap"))


@query("a26_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(s, d):
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return adapters.read(s, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("a29_date_totals", "SELECT date, sum(vol)::BIGINT AS vol, sum(delta)::BIGINT AS delta, max(close) AS max_close FROM c GROUP BY 1", "c")
def _(s, d):
    return bars(s, d).groupBy("date").agg(F.sum("vol").alias("vol"), F.sum("delta").alias("delta"), F.max("close").alias("max_close"))


@query("a30_sparse_tickers", "SELECT p_brand AS ticker, l_suppkey AS broker, count(DISTINCT date_trunc('month', l_shipdate)) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING n < 20")
def _(s, d):
    return adapters.broker_trades(s, d).groupBy("ticker", "broker").agg(F.count_distinct("date").alias("n")).where("n < 20")


@query("a31_ready_dates", "SELECT date FROM d WHERE instrument IN ('click', 'view', 'purchase') GROUP BY date HAVING count(DISTINCT instrument) >= 2", "d")
def _(s, d):
    r = days(s, d).where(F.col("instrument").isin("click", "view", "purchase"))
    return r.groupBy("date").agg(F.count_distinct("instrument").alias("n")).where("n >= 2").select("date")


# ---- broker flow ----


@query("a08_daily_flow", "SELECT date, ticker, CAST(foreign_net AS DOUBLE) AS foreign_net, CAST(local_net AS DOUBLE) AS local_net, CAST(retail_net AS DOUBLE) AS retail_net, CAST(smart_net AS DOUBLE) AS smart_net, CAST(total_value AS DOUBLE) AS total_value, total_lots, buyers, sellers, price FROM f", "f")
def _(s, d):
    return money(flow(s, d).select("date", "ticker", "foreign_net", "local_net", "retail_net", "smart_net", "total_value", "total_lots", "buyers", "sellers", "price"))


CLASSES = {
    "range": "CASE WHEN lower(category) LIKE '%retail%' THEN 'retail' WHEN type = 'Asing' THEN 'foreign' ELSE 'local' END",
    "mvp": "CASE WHEN type = 'Asing' THEN 'foreign' WHEN lower(category) NOT LIKE '%retail%' THEN 'local' END",
    "smart": "CASE WHEN type = 'Asing' THEN 'foreign' ELSE 'local' END",
}
for _variant, _case in CLASSES.items():

    @query(
        f"j15_classifier_{_variant}",
        f"SELECT ticker, CAST(coalesce(sum(sv) FILTER (g2 = 'foreign'), 0) AS DOUBLE) AS foreign_net, CAST(coalesce(sum(sv) FILTER (g2 = 'local'), 0) AS DOUBLE) AS local_net, CAST(coalesce(sum(sv) FILTER (g2 = 'retail'), 0) AS DOUBLE) AS retail_net FROM (SELECT g.*, {_case} AS g2 FROM g JOIN b USING (broker)) GROUP BY 1",
        "g",
    )
    def _(s, d, variant=_variant):
        f = flow(s, d, variant).groupBy("ticker").agg(*[F.sum(f"{g}_net").alias(f"{g}_net") for g in ("foreign", "local", "retail")])
        return money(f)


@query("a10_broker_range", "SELECT broker, CAST(sum(buy) AS DOUBLE) AS buy, CAST(sum(sell) AS DOUBLE) AS sell, CAST(sum(net) AS DOUBLE) AS net, sum(net_lots)::BIGINT AS net_lots FROM n WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1", "n")
def _(s, d):
    t = adapters.broker_trades(s, d).where(F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date")))
    return money(flows.broker_net(t, ("broker",)).select("broker", "buy", "sell", "net", "net_lots"))


@query("a10_broker_volumes", """
SELECT broker, CAST(sum(value) FILTER (side = 'buy') AS DOUBLE) AS buy, CAST(sum(value) FILTER (side = 'sell') AS DOUBLE) AS sell, sum(v) FILTER (side = 'buy') AS buy_volume, sum(v) FILTER (side = 'sell') AS sell_volume
FROM (SELECT *, floor(CASE WHEN lots % 3 = 0 THEN lots * 100 WHEN lots % 3 = 1 THEN CAST(value AS DOUBLE) / (lots + 7) ELSE lots END) AS v FROM bt) GROUP BY 1""", "bt")  # fmt: skip
def _(s, d):
    """A third of the rows has a raw volume, a third an average price, the rest lots alone."""
    t = adapters.broker_trades(s, d).withColumns({"raw": F.when(F.col("lots") % 3 == 0, F.col("lots") * 100).otherwise(0), "avg_price": F.when(F.col("lots") % 3 == 1, F.col("lots") + 7).otherwise(0)})
    t = t.withColumn("v", F.floor(flows.traded_volume(F.col("raw"), F.col("value"), F.col("avg_price"), F.col("lots"))))
    part = lambda c, side: F.sum(F.when(F.col("side") == side, F.col(c))).cast("double")
    return t.groupBy("broker").agg(part("value", "buy").alias("buy"), part("value", "sell").alias("sell"), part("v", "buy").alias("buy_volume"), part("v", "sell").alias("sell_volume"))


@query("a11_accumulation_status", """
, x AS (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY net DESC, broker) AS rb, row_number() OVER (PARTITION BY date, ticker ORDER BY net, broker) AS rs FROM n),
a AS (SELECT date, ticker, coalesce(sum(net) FILTER (rb <= 1 AND net > 0), 0) AS top1_buy, coalesce(sum(net) FILTER (rb <= 3 AND net > 0), 0) AS top3_buy, coalesce(sum(net) FILTER (rb <= 5 AND net > 0), 0) AS top5_buy,
  coalesce(-sum(net) FILTER (rs <= 1 AND net < 0), 0) AS top1_sell, coalesce(-sum(net) FILTER (rs <= 3 AND net < 0), 0) AS top3_sell, coalesce(-sum(net) FILTER (rs <= 5 AND net < 0), 0) AS top5_sell,
  count(*) FILTER (net > 0) AS buyers, count(*) FILTER (net < 0) AS sellers FROM x GROUP BY ALL)
SELECT date, ticker, CAST(top1_buy AS DOUBLE) AS top1_buy, CAST(top3_buy AS DOUBLE) AS top3_buy, CAST(top5_buy AS DOUBLE) AS top5_buy, CAST(top1_sell AS DOUBLE) AS top1_sell, CAST(top3_sell AS DOUBLE) AS top3_sell,
  CAST(top5_sell AS DOUBLE) AS top5_sell, buyers, sellers, CASE WHEN top5_buy > top5_sell * 1.2 THEN 'Big Akum' WHEN top5_buy > top5_sell * 1.05 THEN 'Akumulasi'
  WHEN top5_sell > top5_buy * 1.2 THEN 'Big Dist' WHEN top5_sell > top5_buy * 1.05 THEN 'Distribusi' ELSE 'Neutral' END AS status FROM a""", "n")  # fmt: skip
def _(s, d):
    return money(flows.accumulation_status(adapters.broker_trades(s, d)))


@query("a12_broker_activity", "SELECT broker, count(DISTINCT ticker) AS breadth, CAST(sum(buy) AS DOUBLE) AS buy, CAST(sum(sell) AS DOUBLE) AS sell, CAST(sum(net) AS DOUBLE) AS net FROM n GROUP BY 1", "n")
def _(s, d):
    return money(net(s, d).groupBy("broker").agg(F.count_distinct("ticker").alias("breadth"), *[F.sum(c).alias(c) for c in ("buy", "sell", "net")]))


@query("a13_broker_daily", "SELECT broker, date, CAST(sum(buy + sell) AS DOUBLE) AS total, CAST(sum(net) AS DOUBLE) AS net FROM n GROUP BY ALL HAVING sum(buy + sell) <> 0 OR sum(net) <> 0", "n")
def _(s, d):
    return money(net(s, d).groupBy("broker", "date").agg(F.sum(F.col("buy") + F.col("sell")).alias("total"), F.sum("net").alias("net")).where("total <> 0 OR net <> 0"))


@query("a14_dense_series", """
, top AS (SELECT broker FROM n GROUP BY 1 ORDER BY abs(sum(net)) DESC, broker LIMIT 12)
SELECT g.date, g.broker, CAST(coalesce(sum(n.net), 0) AS DOUBLE) AS net FROM (SELECT DISTINCT date FROM n) dd, top, LATERAL (SELECT dd.date AS date, top.broker AS broker) g
LEFT JOIN n ON n.date = g.date AND n.broker = g.broker GROUP BY ALL""", "n")  # fmt: skip
def _(s, d):
    return money(flows.dense_series(net(s, d), "broker"))


@query("a15_foreign_by_date", "SELECT date, CAST(sum(CASE WHEN buyers > 0 AND sellers > 0 THEN foreign_net END) AS DOUBLE) AS foreign_net, count(*) FILTER (NOT (buyers > 0 AND sellers > 0)) AS incomplete FROM f GROUP BY 1", "f")
def _(s, d):
    whole = (F.col("buyers") > 0) & (F.col("sellers") > 0)
    return money(flow(s, d).groupBy("date").agg(F.sum(F.when(whole, F.col("foreign_net"))).alias("foreign_net"), F.count_if(~whole).alias("incomplete")))


@query("a28_breadth_quadrants", """
, q AS (SELECT broker, sum(net) AS net, sum(buy + sell) AS total, count(DISTINCT ticker) AS breadth FROM n GROUP BY 1),
m AS (SELECT list_sort(list(breadth))[len(list(breadth)) // 2 + 1] AS median FROM q)
SELECT broker, CAST(net AS DOUBLE) AS net, CAST(total AS DOUBLE) AS total, breadth, median, CASE WHEN net >= 0 AND breadth >= median THEN 'Q1' WHEN net < 0 AND breadth >= median THEN 'Q2' WHEN net < 0 THEN 'Q3' ELSE 'Q4' END AS quadrant FROM q, m""", "n")  # fmt: skip
def _(s, d):
    return money(flows.breadth_quadrants(net(s, d)))


@query("w08_accumulation_windows", """
, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM f),
r AS (SELECT *, min((smart_net > 0)::INT) OVER (PARTITION BY ticker ORDER BY k) AS run FROM k),
a AS (SELECT ticker, w, count(*) AS days, sum(foreign_net) AS fn, sum(local_net) AS ln, sum(retail_net) AS rn, sum(run)::BIGINT AS streak, bool_and(smart_net > 0) AS all_pos, bool_and(foreign_net > 0) AS foreign_all_pos,
  bool_and(local_net > 0) AS local_all_pos, arg_max(price, k) AS first_price, arg_min(price, k) AS last_price FROM r, (VALUES (2), (5), (10), (20)) v(w) WHERE k <= w GROUP BY ALL)
SELECT ticker, w, days, CAST(fn AS DOUBLE) AS fn, CAST(ln AS DOUBLE) AS ln, CAST(rn AS DOUBLE) AS rn, streak, all_pos, foreign_all_pos, local_all_pos, first_price, last_price, CAST(fn + ln AS DOUBLE) AS sm, fn > 0 AS foreign_dominant,
  coalesce(CAST((last_price - first_price) * 100 AS DOUBLE) / nullif(CAST(first_price AS DOUBLE), 0), 0) AS pct_chg FROM a WHERE days = w""", "f")  # fmt: skip
def _(s, d):
    return money(flows.accumulation_windows(flow(s, d)))


@query("w09_signed_streak", """
, k AS (SELECT *, sign(net)::INT AS s, first_value(sign(net)::INT) OVER (PARTITION BY ticker, broker ORDER BY date DESC) AS f FROM n),
r AS (SELECT *, min((s = f)::INT) OVER (PARTITION BY ticker, broker ORDER BY date DESC) AS run FROM k)
SELECT ticker, broker, (max(f) * sum(run))::BIGINT AS streak FROM r GROUP BY ALL""", "n")  # fmt: skip
def _(s, d):
    return flows.signed_streak(net(s, d), ("ticker", "broker"))


@query("w10_cumulative_net", "SELECT ticker, broker, date, CAST(sum(net) OVER (PARTITION BY ticker, broker ORDER BY date) AS DOUBLE) AS cum_net FROM n", "n")
def _(s, d):
    return money(flows.cumulative_net(net(s, d), ("ticker", "broker")).select("ticker", "broker", "date", "cum_net"))


@query("w11_foreign_trend", """
, k AS (SELECT *, row_number() OVER w - 1 AS i, CAST(sum(foreign_net) OVER w AS DOUBLE) AS cum FROM f WINDOW w AS (PARTITION BY ticker ORDER BY date)),
a AS (SELECT ticker, count(*) AS days, arg_max(cum, i) AS total, regr_slope(cum, i) AS slope FROM k GROUP BY 1 HAVING count(*) >= 3)
SELECT ticker, days, total, round(slope, 2) AS slope, CASE WHEN total > 0 THEN 2 ELSE 0 END + CASE WHEN slope > 0 THEN 2 ELSE 0 END AS score FROM a""", "f")  # fmt: skip
def _(s, d):
    return flows.flow_trend(flow(s, d)).withColumn("slope", F.round("slope", 2))


@query("w19_cross_section_z", """
, q AS (SELECT ticker, broker, CAST(sum(net) AS DOUBLE) AS net FROM n GROUP BY ALL)
SELECT ticker, broker, net, CASE WHEN count(*) OVER b >= 2 THEN round(coalesce((net - avg(net) OVER b) / nullif(stddev_pop(net) OVER b, 0), 0), 6) END AS z_broker,
  CASE WHEN count(*) OVER t >= 3 THEN round(coalesce((net - avg(net) OVER t) / nullif(stddev_pop(net) OVER t, 0), 0), 6) END AS z_ticker FROM q WINDOW b AS (PARTITION BY broker), t AS (PARTITION BY ticker)""", "n")  # fmt: skip
def _(s, d):
    z = flows.cross_section_z(net(s, d, ("ticker", "broker")))
    return r6(z.select("ticker", "broker", F.col("net").cast("double").alias("net"), "z_broker", "z_ticker"), "z_broker", "z_ticker")


@query("w20_concentration", """
, q AS (SELECT ticker, broker, sum(buy + sell) AS v, sum(net) AS net FROM n GROUP BY ALL)
SELECT ticker, broker, CAST(v AS DOUBLE) / CAST(sum(v) OVER t AS DOUBLE) AS share,
  round(CASE WHEN net >= 0 THEN avg((net >= 0)::INT) OVER t ELSE 1 - avg((net >= 0)::INT) OVER t END * 100, 6) AS herding FROM q WINDOW t AS (PARTITION BY ticker)""", "n")  # fmt: skip
def _(s, d):
    return r6(flows.concentration(net(s, d, ("ticker", "broker"))).select("ticker", "broker", "share", "herding"), "herding")


@query("k03_top_net_buyers", "SELECT ticker, broker, net_lots FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY net_lots DESC, broker) AS k FROM (SELECT ticker, broker, sum(net_lots)::BIGINT AS net_lots FROM n GROUP BY ALL)) WHERE k <= 20", "n")
def _(s, d):
    return relational.top(net(s, d, ("ticker", "broker")), ["ticker"], [F.desc("net_lots"), F.asc("broker")], 20).select("ticker", "broker", "net_lots")


@query("k04_ranked_abs_net", "SELECT broker, ticker, CAST(net AS DOUBLE) AS net, row_number() OVER (PARTITION BY broker ORDER BY abs(net) DESC, ticker) AS place FROM (SELECT broker, ticker, sum(net) AS net FROM n GROUP BY ALL)", "n")
def _(s, d):
    place = F.row_number().over(W.partitionBy("broker").orderBy(F.desc(F.abs("net")), "ticker"))
    return money(net(s, d, ("broker", "ticker")).select("broker", "ticker", "net", place.alias("place")))


# ---- rolling features ----

ZSQL = "coalesce(CASE WHEN count(*) OVER w{n} >= 2 THEN ({c} - avg({c}) OVER w{n}) / nullif(stddev_pop({c}) OVER w{n}, 0) END, 0)"
SMART = """, e AS (SELECT date, ticker, price, foreign_net, CAST(total_value AS DOUBLE) AS effort, CAST(foreign_net AS DOUBLE) AS net,
  coalesce(CAST(price - lag(price) OVER w AS DOUBLE) / nullif(CAST(lag(price) OVER w AS DOUBLE), 0), 0) AS ret FROM f WINDOW w AS (PARTITION BY ticker ORDER BY date)),
x AS (SELECT *, abs(ret) AS result, coalesce(abs(net) / nullif(effort, 0), 0) AS ngr, abs(ret) / (abs(net) + 1e-9) AS elas FROM e)"""


@query("r01_smart_money", SMART + " SELECT date, ticker, effort, net, ret, result, ngr, elas FROM x", "f")
def _(s, d):
    return rolling.smart_money(flow(s, d)).select("date", "ticker", "effort", "net", "ret", "result", "ngr", "elas")


@query("w01_rolling_z", SMART + " SELECT date, ticker, " + ", ".join(f"round({ZSQL.format(c=c, n=n)}, 6) AS z_{c}_{n}" for n in (5, 20) for c in ("effort", "ngr"))
       + " FROM x WINDOW w5 AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)", "f")
def _(s, d):
    z = rolling.rolling_z(rolling.smart_money(flow(s, d)), ("effort", "ngr"), (5, 20))
    return r6(z.select("date", "ticker", *[f"z_{c}_{n}" for n in (5, 20) for c in ("effort", "ngr")]), *[f"z_{c}_{n}" for n in (5, 20) for c in ("effort", "ngr")])


@query("w02_vwap_z", "SELECT instrument, date, round(" + ZSQL.format(c="close", n="5") + ", 6) AS z_vwap_5 FROM d WINDOW w5 AS (PARTITION BY instrument ORDER BY date ROWS 4 PRECEDING)", "d")
def _(s, d):
    return r6(rolling.vwap_z(days(s, d), 5).select("instrument", "date", "z_vwap_5"), "z_vwap_5")


@query("w05a_rvol_rows", "SELECT instrument, date, CASE WHEN count(*) OVER w >= 5 THEN round(CAST(vol AS DOUBLE) / avg(vol) OVER w, 6) END AS rvol_5 FROM d WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "d")
def _(s, d):
    return r6(rolling.relative_volume(days(s, d), 5).select("instrument", "date", "rvol_5"), "rvol_5")


@query("w05b_rvol_positions", """
, z AS (SELECT instrument, date, CASE WHEN vol > 600 THEN vol ELSE 0 END AS vol FROM d)
SELECT instrument, date, CASE WHEN count(*) OVER w >= 5 THEN round(CAST(vol AS DOUBLE) / nullif(avg(nullif(vol, 0)) OVER w, 0), 6) END AS rvol_5 FROM z WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""", "d")  # fmt: skip
def _(s, d):
    z = days(s, d).withColumn("vol", F.when(F.col("vol") > 600, F.col("vol")).otherwise(0))
    return r6(rolling.relative_volume(z, 5, "positions").select("instrument", "date", "rvol_5"), "rvol_5")


@query("w05d_rvol_calendar", "SELECT instrument, date, round(CAST(vol AS DOUBLE) / avg(vol) OVER (PARTITION BY instrument ORDER BY date RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS rvol_5 FROM d", "d")
def _(s, d):
    return r6(rolling.relative_volume(days(s, d), 5, "calendar").select("instrument", "date", "rvol_5"), "rvol_5")


@query("w06_moving_averages", "SELECT instrument, date, " + ", ".join(f"CASE WHEN count(*) OVER w{n} = {n} THEN round(avg(close) OVER w{n}, 6) END AS ma_{n}" for n in (5, 10, 20))
       + " FROM d WINDOW " + ", ".join(f"w{n} AS (PARTITION BY instrument ORDER BY date ROWS {n - 1} PRECEDING)" for n in (5, 10, 20)), "d")
def _(s, d):
    return r6(rolling.moving_averages(days(s, d)).select("instrument", "date", "ma_5", "ma_10", "ma_20"), "ma_5", "ma_10", "ma_20")


@query("w07_rsi", """
, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS k FROM d),
v AS (SELECT instrument, date, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS x FROM k WHERE k <= 35 WINDOW w AS (PARTITION BY instrument ORDER BY date)),
l AS (SELECT instrument, max(date) AS date, list(x ORDER BY i) FILTER (x IS NOT NULL) AS xs FROM v GROUP BY 1),
g AS (SELECT *, list_reduce(list_prepend(list_sum([greatest(q, 0) FOR q IN xs[1:14]]) / 14, [greatest(q, 0) FOR q IN xs[15:]]), lambda a, q: (a * 13 + q) / 14) AS up,
  list_reduce(list_prepend(list_sum([greatest(-q, 0) FOR q IN xs[1:14]]) / 14, [greatest(-q, 0) FOR q IN xs[15:]]), lambda a, q: (a * 13 + q) / 14) AS down FROM l)
SELECT instrument, date, CASE WHEN len(xs) >= 14 THEN round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) END AS rsi FROM g""", "d")  # fmt: skip
def _(s, d):
    return r6(rolling.rsi(days(s, d)), "rsi")


@query("w15_carried_averages", """
, a AS (SELECT instrument, bucket, CAST(avg(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS avg FROM t GROUP BY ALL),
g AS (SELECT instrument, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM a GROUP BY 1)
SELECT instrument, bucket, round(last_value(a.avg IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY bucket), 4) AS avg FROM g LEFT JOIN a USING (instrument, bucket)""", "t")  # fmt: skip
def _(s, d):
    return rolling.carried_averages(ticks(s, d)).withColumn("avg", F.round("avg", 4))


RANKED = "(rank() OVER (PARTITION BY date ORDER BY vol) - 1"


@query("w16_mid_rank", f"SELECT instrument, date, {RANKED} + 0.5 * count(*) OVER (PARTITION BY date, vol)) / count(*) OVER (PARTITION BY date) AS p FROM d", "d")
def _(s, d):
    return days(s, d).select("instrument", "date", rolling.mid_rank(F.col("vol"), ["date"]).alias("p"))


@query("w17_average_rank", f"SELECT instrument, date, coalesce({RANKED} + (count(*) OVER (PARTITION BY date, vol) - 1) / 2.0) / nullif(count(*) OVER (PARTITION BY date) - 1, 0), 0.5) AS p FROM d", "d")
def _(s, d):
    return days(s, d).select("instrument", "date", rolling.average_rank(F.col("vol"), ["date"]).alias("p"))


@query("w18_extreme_moves", "SELECT instrument, date, abs(price_pct) > avg(price_pct) OVER (PARTITION BY date) + 2 * coalesce(nullif(stddev_pop(price_pct) OVER (PARTITION BY date), 0), 1) AS extreme FROM o", "o")
def _(s, d):
    w = W.partitionBy("date")
    p = F.col("price_pct")
    sd = F.coalesce(F.nullif(F.stddev_pop(p).over(w), F.lit(0.0)), F.lit(1.0))
    return tape.order_flow(days(s, d)).select("instrument", "date", (F.abs(p) > F.avg(p).over(w) + 2 * sd).alias("extreme"))


CAL = ", cal AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS day_index, lag(date) OVER (ORDER BY date) AS previous FROM (SELECT DISTINCT date FROM t WHERE dayofweek(date) NOT IN (0, 6)))"


@query("w22_trading_calendar", CAL + " SELECT date, day_index, previous FROM cal", "t")
def _(s, d):
    return rolling.trading_calendar(ticks(s, d))


@query("w04_lookback_cvd", CAL + """ SELECT instrument, date, sum(delta) OVER w AS cvd_5, round(CAST(100 * sum(delta) OVER w AS DOUBLE) / CAST(sum(vol) OVER w AS DOUBLE), 6) AS cvd_pct_5
  FROM d JOIN cal USING (date) WINDOW w AS (PARTITION BY instrument ORDER BY day_index RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)""", "d")  # fmt: skip
def _(s, d):
    x = rolling.lookback_sums(days(s, d), rolling.trading_calendar(ticks(s, d)), (5,))
    return r6(x.select("instrument", "date", "cvd_5", "cvd_pct_5"), "cvd_pct_5")


REGIME = SMART + ", z AS (SELECT *, " + ", ".join(f"{ZSQL.format(c=c, n=20)} AS z_{c}_20" for c in ("effort", "result", "ngr", "elas")) + """, avg(elas) OVER w20 AS em FROM x WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)),
y AS (SELECT *, coalesce(lag(z_effort_20) OVER w, z_effort_20) AS ez, lag(z_effort_20, 2) OVER w AS e2, row_number() OVER w AS k FROM z WINDOW w AS (PARTITION BY ticker ORDER BY date)),
rg AS (SELECT *, CASE WHEN ez < -0.3 AND k > 1 AND coalesce(e2 > 0.3, true) AND z_result_20 > -0.5 AND elas > em * 1.1 THEN 'READY_MARKUP' WHEN ez > 0.5 AND abs(z_result_20) < 0.5 THEN 'TRANSITION'
  WHEN ez > 0.5 AND z_result_20 < -0.5 AND ret >= 0 THEN 'ACCUMULATION' WHEN ez > 0.5 AND ret < -0.01 THEN 'DISTRIBUTION' ELSE 'NEUTRAL' END AS state,
  ez - abs(z_result_20) + (1 - z_elas_20) + 0.5 * z_ngr_20 AS score FROM y)"""


def regimes(s, d) -> DataFrame:
    z = rolling.rolling_z(rolling.smart_money(flow(s, d)), ("effort", "result", "ngr", "elas"), (20,))
    return rolling.regime(z)


@query("r04_regime", REGIME + " SELECT ticker, date, state, round(score, 6) AS score FROM rg", "f")
def _(s, d):
    return r6(regimes(s, d).select("ticker", "date", "state", "score"), "score")


@query("r08_est_delta", "SELECT instrument, date, round(CAST(delta AS DOUBLE) / CAST(vol AS DOUBLE), 6) AS ratio, vol * (CAST(delta AS DOUBLE) / CAST(vol AS DOUBLE)) AS est_delta FROM d", "d")
def _(s, d):
    q = ratio(F.col("delta"), F.col("vol"))
    return days(s, d).select("instrument", "date", F.round(q, 6).alias("ratio"), (F.col("vol") * q).alias("est_delta"))


@query("r10_flow_score", REGIME + " SELECT ticker, date, round(CASE WHEN z_effort_20 > 0 THEN least(z_effort_20 * 2, 4) ELSE 0 END + CASE state WHEN 'ACCUMULATION' THEN 2 WHEN 'READY_MARKUP' THEN 2 WHEN 'TRANSITION' THEN 1 ELSE 0 END + (z_ngr_20 > 0)::INT, 6) AS flow_score FROM rg", "f")
def _(s, d):
    x = regimes(s, d)
    return x.select("ticker", "date", F.round(scoring.flow_score(F.col("z_effort_20"), F.col("z_ngr_20"), F.col("state")), 6).alias("flow_score"))


# ---- scores ----

CTX = """, x0 AS (SELECT *, CASE WHEN delta_pct < -15 THEN 'DISTRIBUTION' WHEN price_pct > 50 THEN 'ACCUMULATION' WHEN price_pct < -60 THEN 'TRANSITION' ELSE 'NEUTRAL' END AS st FROM o),
x AS (SELECT *, lag(st) OVER w AS ctx_state, lag(delta_pct) OVER w / 10 AS ctx_z, lag(st) OVER w IS NOT NULL AS ctx_found FROM x0 WINDOW w AS (PARTITION BY instrument ORDER BY date))"""
UNIT = "((greatest({lo}, least({hi}, {x})) - {lo}) / ({hi} - {lo}))"


def contexts(s, d) -> DataFrame:
    """Order flow with the day before as context."""
    o = tape.order_flow(days(s, d))
    delta, price = F.col("delta_pct"), F.col("price_pct")
    st = F.when(delta < -15, "DISTRIBUTION").when(price > 50, "ACCUMULATION").when(price < -60, "TRANSITION").otherwise("NEUTRAL")
    w = W.partitionBy("instrument").orderBy("date")
    o = o.withColumn("st", st)
    return o.withColumn("ctx_state", F.lag("st").over(w)).withColumn("ctx_z", F.lag("delta_pct").over(w) / 10).withColumn("ctx_found", F.col("ctx_state").isNotNull())


HYBRID = CTX + ", h0 AS (SELECT instrument, date, delta_pct AS dl, price_pct AS pp, coalesce(ctx_state, 'NEUTRAL') AS cs, coalesce(ctx_z, 0) AS z, ctx_found, 0.3 * " + UNIT.format(x="coalesce(ctx_z, 0)", lo="-3.0::DOUBLE", hi="3.0::DOUBLE") + " + 0.7 * " + UNIT.format(x="delta_pct", lo="-100.0::DOUBLE", hi="100.0::DOUBLE") + """ AS b FROM x),
h1 AS (SELECT *, least(1.0::DOUBLE, CASE WHEN pp < -4 THEN b * 0.5 WHEN pp BETWEEN -1 AND 2 THEN b * 1.1 ELSE b END) AS base_score, CASE WHEN NOT ctx_found THEN 1.0 WHEN cs = 'DISTRIBUTION' AND dl > 5 THEN 0.5 WHEN cs = 'DISTRIBUTION' AND dl > 0 AND z < -0.5 THEN 0.6
  WHEN cs = 'ACCUMULATION' AND dl < -5 THEN 0.7 WHEN cs = 'ACCUMULATION' AND dl > 5 AND z > 0.5 THEN 1.2 WHEN cs = 'ACCUMULATION' AND dl > 0 AND z > 0.5 THEN 1.1 WHEN cs = 'DISTRIBUTION' AND dl < -5 THEN 1.0 WHEN cs = 'TRANSITION' AND dl > 5 THEN 0.9 ELSE 1.0 END::DOUBLE AS factor FROM h0),
h2 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, base_score * factor)) AS score, CASE WHEN factor <= 0.5 THEN 'RETAIL_TRAP' WHEN factor <= 0.7 AND cs = 'DISTRIBUTION' THEN 'SM_DIVERGENCE' WHEN factor <= 0.7 AND cs = 'ACCUMULATION' THEN 'SHAKEOUT' END AS div_type FROM h1)"""


@query("c01_hybrid_daily", HYBRID + """ SELECT instrument, date, round(base_score, 6) AS base_score, factor, round(score, 6) AS score, div_type,
  CASE WHEN (NOT ctx_found OR cs = 'NEUTRAL') AND (dl + 100) / 200 > 0.8 AND score > 0.6 AND pp >= -3 THEN 'WATCH_ACCUM' WHEN pp < -5 THEN 'SELL' WHEN div_type = 'RETAIL_TRAP' THEN 'RETAIL_TRAP' WHEN div_type = 'SM_DIVERGENCE' AND score > 0.4 THEN 'SM_DIVERGENCE'
    WHEN score > 0.7 AND cs = 'ACCUMULATION' AND pp >= -2 AND factor >= 1.0 THEN 'STRONG_BUY' WHEN score > 0.6 AND factor >= 1.1 AND cs = 'ACCUMULATION' THEN 'CONFIRMED_ACCUM' WHEN dl > 80 AND z < -0.5 THEN 'TRAP_WARNING'
    WHEN dl < 40 AND z > 0.7 AND cs = 'ACCUMULATION' THEN 'HIDDEN_ACCUM' WHEN score < 0.3 AND cs = 'DISTRIBUTION' THEN 'STRONG_SELL' WHEN score > 0.6 AND pp >= -3 AND factor >= 0.9 THEN 'BUY' WHEN score > 0.5 AND pp >= -3 AND factor >= 0.7 THEN 'WATCH'
    WHEN score < 0.4 THEN 'SELL' ELSE 'NEUTRAL' END AS signal FROM h2""", "o")  # fmt: skip
def _(s, d):
    return r6(scoring.hybrid_daily(contexts(s, d)).select("instrument", "date", "base_score", "factor", "score", "div_type", "signal"), "base_score", "score")


@query("c02_hybrid_range", CTX + ", h AS (SELECT instrument, date, delta_pct AS dl, price_pct AS pp, coalesce(ctx_state, 'NEUTRAL') AS cs, 0.7 * (0.7 * " + UNIT.format(x="delta_pct", lo="-25.0::DOUBLE", hi="25.0::DOUBLE") + " + 0.3 * " + UNIT.format(x="price_pct", lo="-5.0::DOUBLE", hi="5.0::DOUBLE")
       + ") + 0.3 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, " + UNIT.format(x="coalesce(ctx_z, 0)", lo="-3.0::DOUBLE", hi="3.0::DOUBLE") + """ + CASE coalesce(ctx_state, '') WHEN 'ACCUMULATION' THEN 0.1 WHEN 'DISTRIBUTION' THEN -0.1 ELSE 0 END)) AS score FROM x)
SELECT instrument, date, round(score, 6) AS score, CASE WHEN cs = 'ACCUMULATION' AND dl > 0 AND score > 0.75 THEN 'STRONG_BUY' WHEN dl > 0 AND pp > 0 AND score > 0.8 THEN 'MARKUP' WHEN cs = 'DISTRIBUTION' AND dl > 0 THEN 'TRAP_WARNING' WHEN pp <= 0 AND dl > 0 AND cs = 'ACCUMULATION' THEN 'HIDDEN_ACCUM'
  WHEN cs = 'DISTRIBUTION' AND dl < 0 AND score < 0.25 THEN 'STRONG_SELL' WHEN score > 0.6 THEN 'BUY' WHEN score < 0.4 THEN 'SELL' ELSE 'NEUTRAL' END AS signal FROM h""", "o")  # fmt: skip
def _(s, d):
    return r6(scoring.hybrid_range(contexts(s, d)).select("instrument", "date", "score", "signal"), "score")


@query("a18_signal_counts", "SELECT CASE WHEN abs(price_pct) > 50 THEN 'wide' ELSE 'narrow' END AS kind, count(*) AS n, count(*) FILTER (delta > 0) AS bought FROM o GROUP BY 1", "o")
def _(s, d):
    k = F.when(F.abs("price_pct") > 50, "wide").otherwise("narrow")
    return tape.order_flow(days(s, d)).groupBy(k.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("bought"))


#: A probability from regime rows alone; c13_tom2 and c14_swg5 have the full sets of inputs.
SHORT_PARTS = [(0.45, [(0.7, "net", True), (0.3, "z_ngr_20", True)]), (0.35, [(1.0, "ret", True)]), (0.20, [(1.0, "z_effort_20", False)])]


@query("c13_probability")
def _(s, d):
    # z-scores that differ in their last bits are ties
    return scoring.probability(r6(regimes(s, d), "z_ngr_20", "z_effort_20"), SHORT_PARTS, ["date"], "effort").select("ticker", "date", "state", "prob", "prob_label", F.round(F.col("prob_raw") + 1e-12, 6).alias("prob_raw"))


@query("p13_flow_quality", """
, q AS (SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY date) AS pv FROM f JOIN (SELECT date, ticker, count(*) AS freq FROM bt GROUP BY ALL) USING (date, ticker))
SELECT ticker, date, CASE WHEN coalesce(price, 0) <= 0 OR buyers = 0 OR sellers = 0 OR (freq > 0 AND total_value <= 0) THEN 'CRITICAL' WHEN pv > 0 AND abs(CAST(price - pv AS DOUBLE) / pv) > 0.35 THEN 'WARNING' ELSE 'OK' END AS severity FROM q""", "f")  # fmt: skip
def _(s, d):
    freq = adapters.broker_trades(s, d).groupBy("date", "ticker").agg(F.count("*").alias("freq"))
    q = flow(s, d).withColumn("prev_price", F.lag("price").over(W.partitionBy("ticker").orderBy("date")))
    return scoring.quality_issues(q.join(freq, ["date", "ticker"])).select("ticker", "date", "severity")


def completeness(now):
    """A plain state by candle counts alone; see scoring.session_completeness for the rule by session."""
    old, last = F.col("date") < F.to_date(now), F.col("last_bucket")
    late = (F.hour(last) * 60 + F.minute(last)) < 8 * 60 + 50
    stale = (F.unix_timestamp(now) - F.unix_timestamp(last.cast("timestamp"))) > 20 * 60
    return scoring.first_match([(F.coalesce("candles", F.lit(0)) == 0, "NO_DATA"), (F.col("candles") < 10, "SPARSE_DATA"), (old & late, "PAST_DAY_INCOMPLETE"), (~old & stale, "TODAY_STALE")], "COMPLETE")


@query("p14_completeness", """
SELECT instrument, date, CASE WHEN candles < 10 THEN 'SPARSE_DATA' WHEN date < DATE '2024-01-30' AND extract(hour FROM last_bucket) * 60 + extract(minute FROM last_bucket) < 530 THEN 'PAST_DAY_INCOMPLETE'
  WHEN date >= DATE '2024-01-30' AND epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(last_bucket) > 1200 THEN 'TODAY_STALE' ELSE 'COMPLETE' END AS completeness FROM d""", "d")  # fmt: skip
def _(s, d):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return days(s, d).select("instrument", "date", completeness(now).alias("completeness"))


# ---- joins, sets, filters ----


@query("j01_latest_order", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def _(s, d):
    o = adapters.read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


@query("j04_holdings_latest", "SELECT c_custkey, n_name, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def _(s, d):
    o, c, n = (adapters.read(s, d, t) for t in ("orders", "customer", "nation"))
    newest = o.agg(F.max("o_orderdate").alias("o_orderdate"))
    rows = o.join(F.broadcast(newest), "o_orderdate").join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return rows.select("c_custkey", "n_name", "o_orderkey", "o_totalprice")


@query("j06_full_outer_merge", """
SELECT coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.date, b.date) AS date, coalesce(a.vol, b.vol) AS vol, CASE WHEN a.instrument IS NOT NULL THEN 'FULL' ELSE 'ZSCORE' END AS source
FROM (SELECT * FROM d WHERE candles >= 12) a FULL JOIN (SELECT * FROM d WHERE vol > 500) b ON a.instrument = b.instrument AND a.date = b.date""", "d")  # fmt: skip
def _(s, d):
    x = days(s, d)
    return relational.merged([("FULL", x.where("candles >= 12")), ("ZSCORE", x.where("vol > 500"))], ["instrument", "date"], ["vol"])


@query("j08_as_of_strict", "SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, (SELECT max_by(p.o_totalprice, p.o_orderdate) FROM (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL) p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS before FROM orders o")
def _(s, d):
    o = adapters.read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    past = o.groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("before"))
    return relational.as_of(o.drop("o_totalprice"), past, "o_custkey", "o_orderdate", strict=True).select("o_orderkey", "o_custkey", "o_orderdate", "before")


@query("j12_two_day_semi", "SELECT instrument FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS k FROM o) WHERE k <= 4 AND delta_pct > -50 GROUP BY 1 HAVING count(*) >= 2", "o")
def _(s, d):
    o = relational.top(tape.order_flow(days(s, d)), ["instrument"], [F.desc("date")], 4)
    return o.where("delta_pct > -50").groupBy("instrument").agg(F.count("*").alias("n")).where("n >= 2").select("instrument")


@query("j13_missing_dates", "SELECT g.broker, g.date FROM (SELECT DISTINCT k.broker, d.date FROM (SELECT DISTINCT broker FROM n) k, (SELECT DISTINCT date FROM n) d) g ANTI JOIN n ON g.broker = n.broker AND g.date = n.date", "n")
def _(s, d):
    t = adapters.broker_trades(s, d)
    return relational.missing_dates(t, t.select("date").distinct(), "broker")


@query("j14_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    c, o = adapters.read(s, d, "customer"), adapters.read(s, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("u02_event_feed", """
SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS moment FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY moment DESC, kind, id LIMIT 200""")  # fmt: skip
def _(s, d):
    o = adapters.read(s, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    e = adapters.read(s, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    return o.unionByName(e).orderBy(F.desc("moment"), "kind", "id").limit(200)


@query("u04_daily_sets", "SELECT date, list_sort(list(DISTINCT instrument)) AS instruments FROM t GROUP BY 1", "t")
def _(s, d):
    return ticks(s, d).groupBy("date").agg(F.array_sort(F.collect_set("instrument")).alias("instruments"))


@query("u06_later_source_wins", "SELECT instrument, date, coalesce(b.vol * 2, a.vol) AS vol FROM d a LEFT JOIN (SELECT instrument, date, vol FROM d WHERE candles < 12) b USING (instrument, date)", "d")
def _(s, d):
    x = days(s, d).select("instrument", "date", "vol", "candles")
    both = x.withColumn("rank", F.lit(0)).unionByName(x.where("candles < 12").withColumn("vol", F.col("vol") * 2).withColumn("rank", F.lit(1)))
    return relational.first_of(both, ["instrument", "date"], [F.desc("rank")]).select("instrument", "date", "vol")


@query("p05_instrument_search", "SELECT 'T' || p_partkey AS ticker, p_type AS sector, CASE WHEN p_size <= 40 THEN 'ACTIVE' ELSE 'SUSPENDED' END AS status, p_name FROM part WHERE p_size <= 40 AND contains(lower(p_name), 'ring') ORDER BY 'T' || p_partkey LIMIT 500")
def _(s, d):
    i = adapters.instruments(s, d).where(F.col("status") == "ACTIVE").where(F.lower("p_name").contains("ring"))
    return i.orderBy("ticker").limit(500)


@query("p17_missing_hours", "SELECT instrument, date, 8 - count(DISTINCT extract(hour FROM bucket)) FILTER (extract(hour FROM bucket) BETWEEN 2 AND 9) AS missing FROM c GROUP BY ALL", "c")
def _(s, d):
    h = F.hour("bucket")
    return bars(s, d).groupBy("instrument", "date").agg((8 - F.count_distinct(F.when(h.between(2, 9), h))).alias("missing"))


@query("f10_plain_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def _(s, d):
    return adapters.read(s, d, "pages").select("page_id", relational.plain_text("html").alias("text"))
