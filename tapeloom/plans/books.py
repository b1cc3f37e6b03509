"""Queries on book snapshots, envelopes of the tape, digests of snapshots, merged sources and the endpoints built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import activity, relational, screens, tape
from tapeloom.plans import endpoints
from tapeloom.plans.queries import LEVELS, SQL, bars, days, query, r6, signed, ticks
from tapeloom.plans.screens import completeness, repair_plan
from tapeloom.plans.session import NOW, five_minutes
from tapeloom.plans import scans  # noqa: F401  its SQL is used below
from tapeloom.sources import adapters
from tapeloom.streaming import candles


# ---- pressure of the book ----

WINDOW = 10


def _scaled(x: str, low: float, high: float) -> str:
    return f"greatest(0::DOUBLE, least(100::DOUBLE, ({x} - {low}::DOUBLE) / {high - low}::DOUBLE * 100))"


PRESSURE = f"""WITH b AS (SELECT l_suppkey AS instrument, l_orderkey AS place, sum(l_quantity)::DOUBLE AS bid5, sum(l_partkey % 40)::DOUBLE AS ask5, 100 + min(l_linenumber)::DOUBLE AS best_bid, 101 + max(l_linenumber) + max(l_partkey % 3)::DOUBLE AS best_ask FROM lineitem GROUP BY ALL),
m AS (SELECT *, lag(bid5) OVER w AS pb, lag(best_bid) OVER w AS pp, lag(ask5) OVER w AS pa FROM b WINDOW w AS (PARTITION BY instrument ORDER BY place)),
f AS (SELECT *, CAST(bid5 > pb AS INT) AS up, CAST(best_bid = pp AS INT) AS same, CAST(ask5 < pa AS INT) AS down, coalesce(pa < ask5, false) AS back, (best_ask - best_bid) / best_bid * 10000 AS sp FROM m),
g AS (SELECT *, list({{'q': ask5, 'back': back}}) OVER l AS asks, count(*) OVER l AS n, first_value(bid5) OVER l AS fb, first_value(ask5) OVER l AS fa, avg(up) OVER k AS u, avg(same) OVER k AS s, avg(down) OVER k AS dn, avg(sp) OVER l AS spread
  FROM f WINDOW l AS (PARTITION BY instrument ORDER BY place ROWS {WINDOW - 1} PRECEDING), k AS (PARTITION BY instrument ORDER BY place ROWS {WINDOW - 2} PRECEDING)),
h AS (SELECT *, coalesce(nullif(list_sort([x.q FOR x IN asks])[n // 2 + 1], 0), 1) AS med FROM g WHERE n >= 2),
i AS (SELECT *, len([x FOR x IN asks[2:len(asks)] IF x.back AND x.q >= med * 1.5]) AS walls FROM h),
j AS (SELECT *, greatest(0, least(100, 0.45::DOUBLE * {_scaled("(CASE WHEN fb > 0 THEN (bid5 - fb) / fb * 100 ELSE 0 END)", -10, 40)} + 0.35::DOUBLE * {_scaled("u", 0.0, 1.2)} + 0.2::DOUBLE * {_scaled("s", 0.2, 1.0)})) AS bss,
  greatest(0, least(100, 0.45::DOUBLE * {_scaled("(CASE WHEN fa > 0 THEN (fa - ask5) / fa * 100 ELSE 0 END)", -10, 40)} + 0.35::DOUBLE * {_scaled("dn", 0.0, 1.2)} + 0.2::DOUBLE * (100 - greatest(0, least(100, walls / greatest(n - 1, 1) * 200))))) AS ats FROM i)
SELECT instrument, place, """


def snapshots(s, d) -> DataFrame:
    """A supplier's orders as snapshots of its book; its rows are brought together once, for the sums and the windows."""
    li = adapters.read(s, d, "lineitem").repartition("l_suppkey")
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    cells = {"bid5": F.sum("l_quantity"), "ask5": F.sum(part % 40), "best_bid": 100 + F.min(line), "best_ask": 101 + F.max(line) + F.max(part % 3)}
    return li.groupBy(F.col("l_suppkey").alias("instrument"), F.col("l_orderkey").alias("place")).agg(*[x.cast("double").alias(c) for c, x in cells.items()])


def pressures(s, d) -> DataFrame:
    return activity.book_pressure(snapshots(s, d), WINDOW, order="place").where("bss IS NOT NULL")


@query("w14_book_pressure", PRESSURE + "round(bss, 6) AS bss, round(ats, 6) AS ats FROM j")
def _(s, d):
    return r6(pressures(s, d).select("instrument", "place", "bss", "ats"), "bss", "ats")


@query("c15_pressure", PRESSURE + "round(0.4::DOUBLE * bss + 0.4::DOUBLE * ats + 0.2::DOUBLE * greatest(0, least(100, 100 - spread)), 6) AS pressure FROM j")
def _(s, d):
    return r6(pressures(s, d).select("instrument", "place", "pressure"), "pressure")


@query("c16_book_light", PRESSURE + "CASE WHEN bss >= 65 AND ats >= 65 THEN 'GREEN_GREEN' WHEN bss >= 65 AND ats >= 45 THEN 'GREEN_YELLOW' WHEN bss >= 45 AND ats < 45 THEN 'YELLOW_RED' ELSE 'RED_RED' END AS light FROM j")
def _(s, d):
    return pressures(s, d).select("instrument", "place", "light")


# ---- envelopes, snapshots, timelines, samples ----


@query("s24_envelopes", """
WITH e AS (SELECT *, TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS k, event_id % 3 AS form FROM events)
SELECT event_id AS id, date_trunc(CASE WHEN form = 0 THEN 'second' ELSE 'millisecond' END, ts) AS ts, upper(event_type) AS instrument, CASE WHEN event_id % 11 = 0 THEN 'NG' ELSE 'RG' END AS board, value AS price, k AS qty,
  CASE WHEN event_id % 11 = 0 THEN 'board' WHEN NOT value > 0 THEN 'price' WHEN NOT coalesce(k, 0) > 0 THEN 'quantity' END AS reject FROM e""")  # fmt: skip
def _(s, d):
    """Every event as an envelope: a dated line, a line whose time is the envelope's, or an object; read back."""
    e = adapters.ticks(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    local, board, form = F.col("ts") + F.expr("INTERVAL 7 HOURS"), F.when(F.col("seq") % 11 == 0, "NG").otherwise("RG"), F.col("seq") % 3
    code, price, qty = F.lower("instrument"), F.col("price").cast("string"), F.coalesce(F.col("qty").cast("string"), F.lit("-"))
    head = F.when(form == 0, F.concat(F.date_format(local, "yyyyMMdd"), F.lit("|"), F.date_format(local, "HHmmss"))).otherwise("B|1")
    raw = F.when(form < 2, F.concat_ws("|", head, F.lit("0"), code, board, F.lit("T"), price, qty))
    trade = F.when(form == 2, F.struct(code.alias("kode"), board.alias("papan"), F.col("price").alias("harga"), F.col("qty").cast("double").alias("vol")))
    lines = e.select("seq", F.to_json(F.struct(F.lit("lt").alias("src"), F.unix_millis("ts").alias("ts"), raw.alias("raw"), trade.alias("trade"))).alias("line"))
    # the source's name carries the row's number through, as an envelope has no other field for it
    back = lines.select(F.from_json("line", candles.ENVELOPE).alias("x"), "seq").select("x.*", "seq").withColumn("src", F.col("seq").cast("string"))
    n = candles.normalised(back)
    return n.select(F.col("src").cast("long").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "instrument", "board", "price", "qty", "reject")


@query("a23_snapshot_digest", """
, z AS (SELECT instrument, count(*) AS snapshots, arg_min(close, bucket) AS price_open, arg_max(close, bucket) AS price_last, arg_max(high, bucket) AS price_high, arg_max(low, bucket) AS price_low, arg_max(delta, bucket) AS cvd_lot,
  arg_max(delta, bucket) - arg_min(delta, bucket) AS cvd_delta, arg_max(trades, bucket) AS t, arg_max(vol, bucket) AS v FROM c GROUP BY 1)
SELECT instrument AS symbol, CASE WHEN t % 2 = 0 THEN t + v ELSE t END::DOUBLE AS freq_tx, price_open, price_last, price_high, price_low, round((price_last - price_open) * 100 / price_open, 4) AS growth_pct, cvd_lot, cvd_delta, snapshots FROM z""", "c")  # fmt: skip
def _(s, d):
    return screens.snapshot_digest(flow_snapshots(s, d))


def flow_snapshots(s, d) -> DataFrame:
    """Hourly candles as snapshots; every second one by its trades has levels."""
    number = lambda c: F.col(c).cast("double")
    level = F.array(F.struct(number("trades").alias("b_freq"), F.lit(None).cast("double").alias("s_freq"), number("vol").alias("b_lot"), F.lit(3.0).alias("s_lot")), F.struct(F.lit(None).cast("double").alias("b_freq"), number("vol").alias("s_freq"), F.lit(1.0).alias("b_lot"), number("trades").alias("s_lot")))
    c = bars(s, d)
    return c.select(
        F.col("instrument").alias("symbol"), F.col("bucket").alias("ts"), F.col("close").alias("price_last"), F.col("high").alias("price_high"), F.col("low").alias("price_low"), F.col("delta").alias("cvd_lot"), number("trades").alias("freq_tx"),
        F.when(F.col("trades") % 2 == 0, level).otherwise(F.slice(level, 1, 0)).alias("levels"),
    )


@query("t13_timeline_candles", "SELECT instrument AS ticker, strftime(bucket, '%Y-%m-%d %H:%M') AS t, close AS open, close AS high, close AS low, close, vol::DOUBLE AS vol, CASE WHEN trades % 2 = 0 THEN vol * ((trades * 10)::DOUBLE / 50 - 1) ELSE 0 END AS delta FROM c", "c")
def _(s, d):
    point = F.struct(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("t"), F.col("close").alias("p"), F.col("vol").cast("double").alias("dv"), F.when(F.col("trades") % 2 == 0, F.col("trades").cast("double") * 10).alias("haka"))
    rows = bars(s, d).groupBy(F.col("instrument").alias("ticker"), "date").agg(F.collect_list(point).alias("timeline"))  # a day's hours
    return screens.timeline_candles(rows)


@query("p19_compact_map", "SELECT instrument, date, CASE WHEN vol % 3 = 0 THEN CASE WHEN vol % 2 = 0 THEN NULL ELSE round(close / 7 + 1e-9, 2) END ELSE round(open / 3 + 1e-9, 2) END AS w2, CASE WHEN vol % 2 = 0 THEN NULL ELSE round(close / 7 + 1e-9, 2) END AS w5 FROM d", "d")
def _(s, d):
    z = F.create_map(F.lit("2"), F.when(F.col("vol") % 3 != 0, F.col("open") / 3 + 1e-9), F.lit("5"), F.when(F.col("vol") % 2 != 0, F.col("close") / 7 + 1e-9))
    x = days(s, d).select("instrument", "date", screens.compact_map(z).alias("z"))
    return x.select("instrument", "date", F.element_at("z", "2").alias("w2"), F.element_at("z", "5").alias("w5"))


@query("k08_seeded_sample")
def _(s, d):
    """Twenty tickers in a seeded order and two mandatory ones: a sampling operator."""
    i = adapters.instruments(s, d).select("ticker", "sector", "status")
    return screens.sample_with(i, "ticker", 20, ("T1", "T7"))


# ---- repairs ----

BROKEN = """lv AS (SELECT DISTINCT instrument, bucket FROM s WHERE sign <> 0),
bk AS (SELECT instrument, date, bool_or(l.bucket IS NULL) AS broken FROM (SELECT *, row_number() OVER (PARTITION BY instrument, date ORDER BY bucket) AS k FROM c WHERE vol > 0) x LEFT JOIN lv l USING (instrument, bucket) WHERE k <= 10 GROUP BY ALL)"""


def broken_days(s, d) -> DataFrame:
    """Days with an early candle that has volume but no levels; neutral trades make none here."""
    return screens.skeletal(bars(s, d), tape.levels(signed(s, d), "drop"))


@query("p16_skeletal_days", f", {BROKEN} SELECT * FROM bk", "c")
def _(s, d):
    return broken_days(s, d)


@query("p15_repair_plan_skeletal", SQL["p15_repair_plan_thin"].replace("w AS (SELECT instrument, date, bool_or(trades < 2) AS thin FROM (SELECT *, row_number() OVER (PARTITION BY instrument, date ORDER BY bucket) AS k FROM c) WHERE k <= 10 GROUP BY ALL)", BROKEN + ", w AS (SELECT instrument, date, broken AS thin FROM bk)"))
def _(s, d):
    return repair_plan(completeness(s, d).join(broken_days(s, d).withColumnRenamed("broken", "thin"), ["instrument", "date"], "left"))


# ---- sources ----

OTHER = "['click', 'error', 'purchase', 'signup', 'view', 'other'][{key} % 6 + 1] AS instrument, CAST(DATE '2024-01-01' + CAST({day} % 33 AS INT) AS DATE) AS date"


def _named(key: str, day: str) -> list:
    names = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view", "other")))
    return [F.element_at(names, (F.col(key) % 6 + 1).cast("int")).alias("instrument"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col(day) % 33).cast("int")).alias("date")]


@query("j06_three_sources", f"""
, a AS (SELECT instrument, date, vol::DOUBLE AS vol, delta::DOUBLE AS delta, (close - open) * 100 / open AS growth FROM d WHERE candles >= 4),
b AS (SELECT {OTHER.format(key="o_custkey", day="o_orderkey")}, max(o_custkey)::DOUBLE AS score FROM orders WHERE o_custkey % 4 > 0 GROUP BY ALL),
e AS (SELECT {OTHER.format(key="l_suppkey", day="l_partkey")}, sum(l_quantity)::DOUBLE AS vol, count(*)::DOUBLE AS growth FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY ALL),
k AS (SELECT instrument, date FROM a UNION SELECT instrument, date FROM b UNION SELECT instrument, date FROM e)
SELECT k.instrument, k.date, coalesce(a.vol, e.vol) AS vol, a.delta, b.score, round(coalesce(e.growth, a.growth), 6) AS growth,
  CASE WHEN a.instrument IS NOT NULL THEN 'FULL' WHEN b.instrument IS NOT NULL THEN 'ZSCORE' ELSE 'BROKSUM' END AS source FROM k LEFT JOIN a USING (instrument, date) LEFT JOIN b USING (instrument, date) LEFT JOIN e USING (instrument, date)""", "d")  # fmt: skip
def _(s, d):
    """Tape, scores (made from orders) and daily statistics (made from lines): growth comes from the statistics first, volume from the tape."""
    number = lambda c: F.col(c).cast("double")
    full = days(s, d).where("candles >= 4").select("instrument", "date", number("vol").alias("vol"), number("delta").alias("delta"), ((F.col("close") - F.col("open")) * 100 / F.col("open")).alias("growth"))
    scores = adapters.read(s, d, "orders").where("o_custkey % 4 > 0").select(*_named("o_custkey", "o_orderkey"), "o_custkey").groupBy("instrument", "date").agg(F.max("o_custkey").cast("double").alias("score"))
    stats = adapters.read(s, d, "lineitem").where("l_suppkey % 3 > 0").select(*_named("l_suppkey", "l_partkey"), "l_quantity").groupBy("instrument", "date").agg(F.sum("l_quantity").cast("double").alias("vol"), F.count("*").cast("double").alias("growth"))
    out = relational.merged([("FULL", full), ("ZSCORE", scores), ("BROKSUM", stats)], ["instrument", "date"], ["vol", "delta", "score", "growth"], {"growth": ["BROKSUM", "FULL"], "vol": ["FULL", "BROKSUM"]})
    return r6(out, "growth")


# ---- endpoints ----


@query("e_sector_cvd", """
, s1 AS (SELECT instrument, bucket, close, delta, trades, vol, date, row_number() OVER (PARTITION BY instrument, date ORDER BY bucket) AS place FROM c)
SELECT upper(instrument || '_' || strftime(date, '%d')) AS symbol, 'S' || place AS sector, CASE WHEN delta <> 0 THEN delta::DOUBLE WHEN trades % 2 = 0 THEN vol - 3 + 1 - trades::DOUBLE END AS cvd_lot, trades::DOUBLE AS freq_tx, close AS price_last FROM s1 WHERE place = 1""", "c")  # fmt: skip
def _(s, d):
    """A day's first hour lists the symbol first; a delta of 0 counts as not given."""
    x = flow_snapshots(s, d).withColumn("day", F.to_date("ts"))
    place = F.row_number().over(screens.W.partitionBy("symbol", "day").orderBy("ts"))
    x = x.withColumns({"place": place, "cvd_lot": F.nullif("cvd_lot", F.lit(0))}).withColumn("sector", F.concat(F.lit("S"), "place"))
    return screens.sector_cvd(x.withColumn("symbol", F.concat_ws("_", "symbol", F.date_format("day", "dd"))))


@query("e_order_flow_snapshots", "SELECT instrument AS symbol, max(bucket) AS ts, arg_max(close, bucket) AS price_last, arg_max(delta, bucket) AS cvd_lot FROM c WHERE instrument IN ('click', 'view', 'login') GROUP BY 1", "c")
def _(s, d):
    return screens.order_flow_snapshots(flow_snapshots(s, d), "click, VIEW,login,,x1,toolongname,click").select("symbol", "ts", "price_last", "cvd_lot")


@query("e_indicators", f"""
, ma AS (SELECT instrument, date, {", ".join(f"CASE WHEN count(*) OVER w{n} = {n} THEN round(avg(close) OVER w{n}, 6) END AS ma_{n}" for n in (5, 10, 20))},
  {", ".join(f"CASE WHEN count(*) OVER v{n} >= {n} THEN round(vol / avg(nullif(vol, 0)) OVER v{n}, 6) END AS rvol_{n}" for n in (2, 5, 10, 20))} FROM d
  WINDOW {", ".join(f"w{n} AS (PARTITION BY instrument ORDER BY date ROWS {n - 1} PRECEDING)" for n in (5, 10, 20))}, {", ".join(f"v{n} AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (2, 5, 10, 20))}),
v AS {SQL["w07_rsi_all_dates"].split(", v AS ", 1)[1].replace("SELECT instrument, date, CASE WHEN len(xs)", "r AS (SELECT instrument, date, CASE WHEN len(xs)").replace("FROM h)" + chr(10) + "r AS", "FROM h), r AS")})
SELECT ma.*, rsi AS rsi_14 FROM ma JOIN r USING (instrument, date) WHERE date = DATE '2024-01-26'""", "d")  # fmt: skip
def _(s, d):
    out = endpoints.indicators(days(s, d), F.lit("2024-01-26").cast("date"))
    names = [*[f"ma_{n}" for n in (5, 10, 20)], *[f"rvol_{n}" for n in (2, 5, 10, 20)], "rsi_14"]
    return r6(out.select("instrument", "date", *names), *names)


@query("e_raw_history", f"""
, {BROKEN},
x AS (SELECT instrument, date, count(*) FILTER (vol > 0) AS traded, max(bucket) FILTER (vol > 0) AS last, date = DATE '2024-01-29' AS today FROM c GROUP BY ALL),
e AS (SELECT *, CASE WHEN today THEN 6 ELSE 7 END AS expected, extract(hour FROM last) * 60 + extract(minute FROM last) AS ends FROM x),
st AS (SELECT e.instrument, e.date, coalesce(broken, false) AS broken, CASE WHEN traded = 0 THEN 'NO_DATA' WHEN traded < greatest(expected // 2, 5) THEN 'SPARSE_DATA' WHEN NOT today AND ends < 530 THEN 'PAST_DAY_INCOMPLETE'
  WHEN today AND epoch(TIMESTAMP '2024-01-29 08:20:00') - epoch(last) > 1200 THEN 'TODAY_STALE' ELSE 'COMPLETE' END AS completeness FROM e LEFT JOIN bk USING (instrument, date)),
tl AS (SELECT instrument, date, bucket, close AS open, close AS high, close AS low, close, vol, delta FROM c5 WHERE extract(day FROM date) % 4 > 0),
o AS (SELECT instrument, date, bucket, open, high, low, close, vol, delta, false AS is_fallback FROM c JOIN st USING (instrument, date) WHERE (completeness = 'COMPLETE' AND NOT broken) OR (instrument, date) NOT IN (SELECT instrument, date FROM tl)
  UNION ALL SELECT *, true FROM tl ANTI JOIN (SELECT * FROM st WHERE completeness = 'COMPLETE' AND NOT broken) USING (instrument, date))
SELECT o.*, completeness, broken, broken OR completeness NOT IN ('COMPLETE', 'SPARSE_DATA', 'NO_DATA') AS is_repairing FROM o JOIN st USING (instrument, date)""", "c", "c5")  # fmt: skip
def _(s, d):
    """Hourly candles with their quality; on three days of four a five-minute timeline can stand in."""
    flat = five_minutes(s, d).where("day(date) % 4 > 0").select("instrument", "date", "bucket", *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "vol", "delta")
    out = endpoints.raw_history(bars(s, d), tape.levels(signed(s, d), "drop"), flat, F.lit(NOW).cast("timestamp"), opens=2 * 60, closes=9 * 60, width=60)
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
