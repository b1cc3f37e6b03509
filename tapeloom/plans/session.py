"""Queries on minutes and five minutes, completeness by session, five windows and both probabilities."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio
from tapeloom.operators import activity, rolling, scoring, tape
from tapeloom.plans.queries import DAY_SUMMARY, LEVELS, NEEDS, PARTS, REGIME, SHORT_PARTS, SMART, SQL, bars, days, flow, query, r6, with_parts
from tapeloom.sources import adapters

CANDLES = """SELECT instrument, date, bucket, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
             sum(qty)::BIGINT AS vol, sum(qty * sign)::BIGINT AS delta, count(*) AS trades FROM {signed} GROUP BY ALL"""
PARTS |= {
    # the sign starts anew every minute
    "s1": """SELECT * REPLACE (date_trunc('minute', ts) AS bucket), coalesce(sign(price - lag(price) OVER (PARTITION BY instrument, date_trunc('minute', ts) ORDER BY ts, seq)), 0)::INT AS sign FROM t""",
    "c1": CANDLES.format(signed="s1"),
    # five minutes; an equal price keeps the day's last direction
    "m5": """SELECT * REPLACE (time_bucket(INTERVAL '5 minutes', ts) AS bucket), nullif(sign(price - lag(price) OVER (PARTITION BY instrument, date ORDER BY ts, seq)), 0) AS m FROM t""",
    "s5": "SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY instrument, date ORDER BY ts, seq), 0)::INT AS sign FROM m5",
    "c5": CANDLES.format(signed="s5"),
}
NEEDS |= {"s1": ["t"], "c1": ["s1"], "m5": ["t"], "s5": ["m5"], "c5": ["s5"]}

FIVE = "5 minutes"
ROLLED = "SELECT instrument, time_bucket(INTERVAL '5 minutes', bucket) AS bucket, arg_min(open, bucket) AS open, max(high) AS high, min(low) AS low, arg_max(close, bucket) AS close, sum(vol)::BIGINT AS vol, sum(delta)::BIGINT AS delta FROM c1 GROUP BY instrument, time_bucket(INTERVAL '5 minutes', bucket)"


def trades(s, d, width: str, mode: str):
    return tape.signed(tape.bucketed(tape.valid(adapters.ticks(s, d)), width), mode)


def minutes(s, d):
    return trades(s, d, "minute", "minute_tick")


@query("t01_minute_candles", "SELECT * FROM c1", "c1")
def _(s, d):
    return tape.candles(minutes(s, d))


@query("t02_minute_levels_drop", LEVELS.format(half="0", rest="0").replace("FROM s GROUP", "FROM s1 GROUP"), "s1")
def _(s, d):
    return tape.levels(minutes(s, d), "drop")


@query("t05_five_minutes", "SELECT instrument, time_bucket(INTERVAL '5 minutes', ts) AS bucket, count(*) AS n, sum(qty)::BIGINT AS qty FROM t GROUP BY instrument, time_bucket(INTERVAL '5 minutes', ts)", "t")
def _(s, d):
    return tape.bucketed(tape.valid(adapters.ticks(s, d)), FIVE).groupBy("instrument", "bucket").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("a19_rollup_5m_candles", ROLLED, "c1")
def _(s, d):
    return tape.rolled(tape.candles(minutes(s, d)), FIVE)


@query("a19_rollup_5m_levels", "SELECT instrument, time_bucket(INTERVAL '5 minutes', bucket) AS bucket, p, sum(bv)::BIGINT AS bv, sum(av)::BIGINT AS av FROM (" + LEVELS.format(half="qty // 2", rest="qty - qty // 2").replace("FROM s GROUP", "FROM s1 GROUP") + ") GROUP BY instrument, time_bucket(INTERVAL '5 minutes', bucket), p", "s1")
def _(s, d):
    return tape.rolled_levels(tape.levels(minutes(s, d)), FIVE)


def five_minutes(s, d):
    return tape.candles(trades(s, d, FIVE, "day_tick_carry"))


@query("t03_day_summary_5m", DAY_SUMMARY.replace("FROM c)", "FROM c5)"), "c5")
def _(s, d):
    return r6(tape.day_summary(five_minutes(s, d)), "hidden_acc")


NOW = "2024-01-29 08:20:00"  # inside the session of a Monday; the session is 02:00 to 09:00 UTC


@query("p14_session_completeness", """
, x AS (SELECT instrument, date, count(*) FILTER (vol > 0) AS traded, max(bucket) FILTER (vol > 0) AS last, date = DATE '2024-01-29' AS today FROM c5 GROUP BY ALL),
e AS (SELECT *, CASE WHEN today THEN 76 ELSE 84 END AS expected, extract(hour FROM last) * 60 + extract(minute FROM last) AS ends FROM x)
SELECT instrument, date, CASE WHEN traded = 0 THEN 'NO_DATA' WHEN traded < greatest(expected // 2, 5) THEN 'SPARSE_DATA' WHEN NOT today AND ends < 530 THEN 'PAST_DAY_INCOMPLETE'
  WHEN today AND epoch(TIMESTAMP '2024-01-29 08:20:00') - epoch(last) > 1200 THEN 'TODAY_STALE' ELSE 'COMPLETE' END AS completeness FROM e""", "c5")  # fmt: skip
def _(s, d):
    has = F.col("vol") > 0
    x = five_minutes(s, d).groupBy("instrument", "date").agg(F.count_if(has).alias("traded"), F.max(F.when(has, F.col("bucket"))).alias("last_bucket"))
    state = scoring.session_completeness(F.lit(NOW).cast("timestamp"), opens=2 * 60, closes=9 * 60)
    return x.select("instrument", "date", state.alias("completeness"))


def _z(c: str, n: int) -> str:
    over = f"OVER (PARTITION BY x.ticker ORDER BY x.date ROWS {n - 1} PRECEDING)"
    return f"coalesce(CASE WHEN count(*) {over} >= 2 THEN ({c} - avg({c}) {over}) / nullif(stddev_pop({c}) {over}, 0) END, 0)"


Z_COLUMNS = ("effort", "result", "ngr", "elas")


@query("w01_five_windows", SMART + " SELECT ticker, date, " + ", ".join(f"round({_z(c, n)}, 6) AS z_{c}_{n}" for n in (2, 5, 10, 20, 60) for c in Z_COLUMNS) + " FROM x", "f")
def _(s, d):
    names = [f"z_{c}_{n}" for n in (2, 5, 10, 20, 60) for c in Z_COLUMNS]
    return r6(rolling.rolling_z(rolling.smart_money(flow(s, d)), Z_COLUMNS, (2, 5, 10, 20, 60)).select("ticker", "date", *names), *names)


@query("w13_rank_trend", """
, r AS (SELECT instrument, bucket, row_number() OVER (PARTITION BY bucket ORDER BY vol DESC, instrument) AS rank FROM c QUALIFY rank <= 3),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY instrument ORDER BY bucket) AS DOUBLE) AS i FROM r)
SELECT instrument, bucket, rank, rank - first_value(rank) OVER (PARTITION BY instrument ORDER BY bucket ROWS 5 PRECEDING) AS rank_change,
  round(CASE WHEN count(*) OVER w >= 3 THEN regr_slope(rank, i) OVER w ELSE 0 END + 1e-12, 6) AS rank_slope FROM i WINDOW w AS (PARTITION BY instrument ORDER BY bucket ROWS 9 PRECEDING)""", "c")  # fmt: skip
def _(s, d):
    ranked = activity.rank_trail(bars(s, d).select("instrument", "bucket", "vol"), "instrument", "bucket", "vol", 3)
    return activity.rank_trend(ranked, "instrument", "bucket").select("instrument", "bucket", "rank", "rank_change", rounded("rank_slope"))


def _scaled(x: str, low: float, high: float) -> str:
    return f"greatest(-3::DOUBLE, least(3::DOUBLE, (({x}) - {low}::DOUBLE) / {high - low}::DOUBLE * 6 - 3))"


@query("r06_scaled_features", f"""
, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS w FROM d) WHERE w <= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) AS u FROM l),
a AS (SELECT instrument, count(*) AS days, avg(vol) AS av, 100 * (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) AS pc, avg(CAST(delta * 100 AS DOUBLE) / vol) AS dp,
  sum(delta) FILTER (w <= 5) AS recent, sum(delta) FILTER (u <= 5) AS early FROM k GROUP BY 1 HAVING count(*) >= 5)
SELECT instrument, days, round({_scaled("av", 0, 1e7)}, 6) AS effort, round({_scaled("pc", -10, 10)}, 6) AS response, round({_scaled("dp", -50, 50)}, 6) AS quality, round({_scaled("pc / (av / 1000000)", -1, 1)}, 6) AS elasticity_z,
  CASE WHEN recent > early * 1.5 AND recent > 0 THEN 'ACCUMULATION' WHEN recent < early * 0.5 AND recent < 0 THEN 'DISTRIBUTION' WHEN recent > 0 AND pc > 2 THEN 'READY_MARKUP' WHEN recent < 0 AND pc < -2 THEN 'POTENTIAL_TOP' ELSE 'NEUTRAL' END AS state FROM a""", "d")  # fmt: skip
def _(s, d):
    names = list(activity.FEATURE_RANGES)
    return r6(activity.scaled_features(days(s, d)).select("instrument", "days", *names, "state"), *names)


# ---- the probabilities, with all their inputs ----

EFFORTS = (2, 5, 10)
SUMS = {"sm": ("smart_net", (2, 5, 10, 20)), "flow": ("foreign_net", (5, 10))}
#: Order flow before this day counts as too old; the same day bounds the screener's age.
FRESH = "1995-01-01"

FEATURES = (
    ", ft AS (SELECT x.ticker, x.date, state, CAST(total_value AS DOUBLE) AS netv, "
    + ", ".join(f"round({_z('effort', n)}, 6) AS eff{n}" for n in EFFORTS)
    + ", "
    + ", ".join(f"CAST(sum({c}) OVER (PARTITION BY x.ticker ORDER BY x.date ROWS {n - 1} PRECEDING) AS DOUBLE) AS {k}{n}" for k, (c, windows) in SUMS.items() for n in windows)
    + ", "
    + ", ".join(f"round(CAST(sum(total_value) OVER (PARTITION BY x.ticker ORDER BY x.date ROWS {n - 1} PRECEDING) AS DOUBLE) / CAST(sum(total_lots) OVER (PARTITION BY x.ticker ORDER BY x.date ROWS {n - 1} PRECEDING) AS DOUBLE), 6) AS vwap{n}" for n in (5, 10))
    + ", "
    + ", ".join(f"100 * CAST(sum(smart_net) OVER (PARTITION BY x.ticker ORDER BY x.date ROWS {n - 1} PRECEDING) AS DOUBLE) / CAST(sum(total_value) OVER (PARTITION BY x.ticker ORDER BY x.date ROWS {n - 1} PRECEDING) AS DOUBLE) AS cvd_pct_{n}d" for n in (5, 10))
    + """, 100 * CAST(x.price - lag(x.price) OVER w AS DOUBLE) / CAST(nullif(lag(x.price) OVER w, 0) AS DOUBLE) AS order_mom_pct, 100 * CAST(smart_net AS DOUBLE) / CAST(total_value AS DOUBLE) AS order_delta_pct,
  CAST(sum(smart_net) OVER (PARTITION BY x.ticker ORDER BY x.date ROWS 4 PRECEDING) AS DOUBLE) AS order_cvd FROM (SELECT x.ticker, x.date, x.price, x.effort, smart_net, f.foreign_net, total_value, total_lots, rg.state FROM x JOIN rg USING (ticker, date) JOIN f USING (ticker, date)) x WINDOW w AS (PARTITION BY x.ticker ORDER BY x.date)),
fa AS (SELECT *, round(abs(order_delta_pct) / (1 + abs(order_mom_pct)), 6) AS order_absorb, vwap5 > vwap10 AS vwap_up FROM ft)"""
)


def features(s, d):
    """Inputs of the probabilities for every ticker and day, from the broker flow."""
    z = rolling.rolling_z(rolling.smart_money(flow(s, d)), Z_COLUMNS, (20,))
    z = rolling.rolling_z(rolling.regime(z), ("effort",), EFFORTS)
    w = W.partitionBy("ticker").orderBy("date")
    total = lambda c, n: F.sum(c).over(w.rowsBetween(1 - n, 0)).cast("double")
    before = F.lag("price").over(w)
    x = z.select(
        "ticker", "date", "state", F.col("total_value").cast("double").alias("netv"),
        *[F.round(f"z_effort_{n}", 6).alias(f"eff{n}") for n in EFFORTS],
        *[total(c, n).alias(f"{k}{n}") for k, (c, windows) in SUMS.items() for n in windows],
        *[F.round(ratio(total("total_value", n), total("total_lots", n)), 6).alias(f"vwap{n}") for n in (5, 10)],
        *[(100 * total("smart_net", n) / total("total_value", n)).alias(f"cvd_pct_{n}d") for n in (5, 10)],
        ratio(100 * (F.col("price") - before), before).alias("order_mom_pct"),
        (100 * F.col("smart_net").cast("double") / F.col("total_value").cast("double")).alias("order_delta_pct"),
        total("smart_net", 5).alias("order_cvd"),
    )
    return x.withColumns({"order_absorb": F.round(F.abs("order_delta_pct") / (1 + F.abs("order_mom_pct")), 6), "vwap_up": F.col("vwap5") > F.col("vwap10")})


def _pct(c: str) -> str:
    n = f"count({c}) OVER (PARTITION BY date)"
    rank = f"(rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) - 1 + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0::DOUBLE) / nullif({n} - 1, 0)"
    return f"CASE WHEN {c} IS NULL OR {n} <= 1 THEN 0.5::DOUBLE ELSE {rank} END"


def _scored(parts: list, name: str, trend: str, fresh: str) -> str:
    """The SQL of a probability: percentiles by date, weighted, through the sigmoid."""
    columns = list(dict.fromkeys(c for _, inner in parts for _, c, _ in inner))
    centred = ", ".join(f"2 * ({_pct(c)}) - 1 AS p_{c}" for c in columns)
    one = lambda c, gate: f"CASE WHEN {c} IS NULL THEN 0 WHEN {c} <= 0 THEN least(0::DOUBLE, p_{c}) ELSE p_{c} END" if gate else f"p_{c}"
    total = " + ".join(f"{w}::DOUBLE * (" + " + ".join(f"{v}::DOUBLE * ({one(c, g)})" for v, c, g in inner) + ")" for w, inner in parts)
    return f""", pc AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, (({_pct("netv")}) - 0.1) / 0.4)) AS liq, {centred} FROM fa),
rw AS (SELECT *, liq * ({total}) + CASE state WHEN 'READY_MARKUP' THEN 0.1 WHEN 'ACCUMULATION' THEN 0.06 WHEN 'TRANSITION' THEN 0.02 ELSE 0 END + {trend} AS p_raw, {fresh} AS fresh FROM pc),
sc AS (SELECT *, CASE WHEN state = 'DISTRIBUTION' THEN 5 ELSE greatest(5, least(90, floor(5 + 85 / (1 + exp(-4 * p_raw)) + 0.5))) END::DOUBLE AS p_score FROM rw)
SELECT ticker, date, CASE WHEN fresh THEN p_score END AS {name}, round(CASE WHEN fresh THEN CASE WHEN state = 'DISTRIBUTION' THEN 0 ELSE p_raw END END + 1e-12, 6) AS {name}_raw,
  CASE WHEN NOT fresh THEN 'NA' WHEN state = 'DISTRIBUTION' THEN 'DISQ' WHEN p_score >= 70 THEN 'HIGH' WHEN p_score >= 50 THEN 'MED' WHEN p_score >= 35 THEN 'LOW' ELSE 'VLOW' END AS {name}_label FROM sc"""


def rounded(c: str):
    """To six digits; exact halves, which many weighted ranks are, go up whatever the last bit says."""
    return F.round(F.col(c) + 1e-12, 6).alias(c)


AGE = f"date >= DATE '{FRESH}'"


@query("c13_tom2", REGIME + FEATURES + _scored(scoring.TWO_DAYS, "tom2", "0", f"{AGE} AND order_mom_pct IS NOT NULL AND order_delta_pct IS NOT NULL"), "f")
def _(s, d):
    fresh = F.col("date") >= F.lit(FRESH).cast("date")
    return scoring.two_day_probability(features(s, d), ["date"], fresh).select("ticker", "date", "tom2", rounded("tom2_raw"), "tom2_label")


@query("c14_swg5", REGIME + FEATURES + _scored(scoring.FIVE_DAYS, "swg5", "CASE WHEN vwap_up THEN 0.05 ELSE 0 END", AGE), "f")
def _(s, d):
    fresh = F.col("date") >= F.lit(FRESH).cast("date")
    return scoring.five_day_probability(features(s, d), ["date"], fresh).select("ticker", "date", "swg5", rounded("swg5_raw"), "swg5_label")


SQL["c13_probability"] = with_parts(
    REGIME + ", fa AS (SELECT * REPLACE (round(z_ngr_20, 6) AS z_ngr_20, round(z_effort_20, 6) AS z_effort_20), effort AS netv FROM rg)" + _scored(SHORT_PARTS, "prob", "0", "true").replace("SELECT ticker, date, CASE WHEN fresh", "SELECT ticker, date, state, CASE WHEN fresh"), "f"
)
