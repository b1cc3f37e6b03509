"""Queries of parsers, table rules and order books: lines and books are made from the given tables, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import flows, relational, rolling, screens, tape
from tapeloom.plans.queries import bars, days, net, query, ticks
from tapeloom.sources import adapters, parsers, tables

# ---- lines ----


def lines(s, d, *fields, of: str = "lineitem", sep: str = "|"):
    """One raw line of every row of a table."""
    return adapters.read(s, d, of).select(F.concat_ws(sep, *[f if not isinstance(f, str) else F.expr(f) for f in fields]).alias("raw"))


@query("s20_sector_line", """
SELECT 'S' || p_partkey AS symbol, 'RG' AS board, CASE WHEN p_size % 7 = 0 THEN greatest(CAST(p_size + 1 AS DOUBLE), CAST(p_size AS DOUBLE)) ELSE CAST(p_size + 5 AS DOUBLE) END AS price_high,
  CAST(p_size AS DOUBLE) AS price_low, CAST(p_size + 1 AS DOUBLE) AS price_last, CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS DOUBLE) END AS freq_tx FROM part WHERE p_partkey % 3 > 0""")  # fmt: skip
def _(s, d):
    # a line in three is too short, a high in seven and a frequency in five are 0
    head = ["'a'", "'b'", "concat(' s', p_partkey)", "'rg '"]
    body = ["'x'", "IF(p_size % 7 = 0, 0, p_size + 5)", "p_size", "p_size + 1"]
    tail = ["IF(p_partkey % 3 > 0, concat_ws('|', 'y', 'z', p_size % 5), 'end')"]
    return parsers.sector_line(lines(s, d, *head, *body, *tail, of="part")).drop("raw")


@query("s21_level_line", """
SELECT l_orderkey AS id, l_linenumber AS nr, CAST(l_suppkey AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS b_lot, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber - 1 AS DOUBLE) END AS s_lot,
  l_quantity + CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 ELSE 0 END AS t_lot FROM lineitem WHERE l_suppkey % 4 > 0""")  # fmt: skip
def _(s, d):
    raw = F.concat_ws("|", F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey")).otherwise(F.lit(0)).cast("string"), F.col("l_quantity").cast("string"), (F.col("l_linenumber") - 1).cast("string"), F.lit("x"), F.lit("7"))
    rows = adapters.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return parsers.level_line(rows).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nr"), "price", "b_lot", "s_lot", "t_lot")


@query("s22_done_line", """
SELECT CAST(event_id AS VARCHAR) AS trade_id, upper(event_type) AS symbol, strftime(ts, '%H:%M:%S') AS time, value AS price, event_id % 90 AS lot FROM events WHERE event_id % 10 > 0 AND event_id % 90 > 0 AND value > 0""")  # fmt: skip
def _(s, d):
    raw = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.when(F.col("event_id") % 10 > 0, "rg").otherwise("NG"), F.date_format("ts", "HH:mm:ss"), F.col("value").cast("string"), (F.col("event_id") % 90).cast("string"))
    return parsers.done_line(adapters.read(s, d, "events").select(raw.alias("raw"))).select("trade_id", "symbol", "time", "price", "lot")


@query("s23_calendar_line", """
SELECT upper(substr(o_orderpriority, 3)) AS event_type, 'cash' AS event_subtype, CAST(o_orderkey AS VARCHAR) AS seq, CASE WHEN o_orderkey % 2 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS epoch,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 7 HOUR ELSE o_orderdate END AS DATE) AS event_date, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 7 HOUR, '%H:%M') END AS event_time,
  'C' || o_custkey AS symbol_primary, CASE WHEN o_orderkey % 3 = 0 THEN ['C' || o_custkey, 'X'] ELSE [] END AS symbols, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 < 2""")  # fmt: skip
def _(s, d):
    o = adapters.read(s, d, "orders").where("o_orderkey % 3 < 2")
    third, even = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2 == 0
    name = F.concat(F.lit("c"), F.col("o_custkey"))
    at = lambda p: F.when(~even, F.date_format("o_orderdate", p)).otherwise("")
    # the primary symbol is given, or the first of the list
    raw = F.concat_ws(
        "|", F.substring("o_orderpriority", 3, 99), F.lit("cash"), F.col("o_orderkey").cast("string"), F.when(even, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(""), at("yyyy"), at("M"), at("d"),
        F.when(third, F.concat(name, F.lit(", x"))).otherwise(""), F.when(third, "").otherwise(name), "o_orderstatus",
    )
    return parsers.calendar_line(o.select(raw.alias("raw"))).select("event_type", "event_subtype", "seq", "epoch", "event_date", "event_time", "symbol_primary", "symbols", "status")


BOOK = """
, r AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS k, l_quantity AS q, l_linenumber AS p FROM lineitem),
v AS (SELECT l_suppkey AS id, list({'price': CAST(p AS DOUBLE), 'volume': CASE WHEN k % 2 = 1 THEN q ELSE 0 END} ORDER BY k) AS b, list({'price': CAST(p AS DOUBLE), 'volume': CASE WHEN k % 3 = 0 THEN q ELSE 0 END} ORDER BY k) AS o FROM r WHERE k <= 9 GROUP BY 1)
SELECT id, CASE WHEN id % 2 = 0 THEN 'INIT' ELSE 'UPDATE' END AS subcmd, CASE WHEN id % 2 = 0 THEN b[1].price ELSE 7 END AS best_bid, CASE WHEN id % 2 = 0 THEN o[1].price ELSE 8 END AS best_offer,
  [[x.price, x.volume] FOR x IN CASE WHEN id % 2 = 0 THEN b[1:3] ELSE list_filter(b, lambda x: x.volume > 0)[1:3] END] AS bids,
  [[x.price, x.volume] FOR x IN CASE WHEN id % 2 = 0 THEN list_reverse(o[1:3]) ELSE list_filter(o, lambda x: x.volume > 0)[1:3] END] AS offers FROM v""".replace(", r AS", "WITH r AS", 1)  # fmt: skip
#: A supplier may have one line number of one order twice: then that of the smaller quantity comes first, and no tie is left.
BOOK_ORDERED = BOOK.replace("ORDER BY l_orderkey, l_linenumber)", "ORDER BY l_orderkey, l_linenumber, l_quantity)")


@query("s26_book_payload_ordered", BOOK_ORDERED)
@query("s26_book_payload", BOOK)
def _(s, d):
    """A supplier's first lines as its book: snapshots for even numbers (in half of them inside another object), else updates."""
    li = adapters.read(s, d, "lineitem")
    k = relational.top(li, ["l_suppkey"], [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_quantity")], 9)
    rows = k.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q")))).alias("r"))
    vol = lambda n, rest: lambda x, i: F.when((i + 1) % n == rest, x["q"]).otherwise(F.lit(0.0))
    text = lambda c: c.cast("int").cast("string")
    pairs = lambda n, rest: F.transform("r", lambda x, i: F.array(x["l_linenumber"].cast("double"), vol(n, rest)(x, i)))
    init = F.to_json(F.struct(F.lit("INIT").alias("subcmd"), pairs(2, 1).alias("BUY"), pairs(3, 0).alias("SELL")))
    init = F.when(F.col("l_suppkey") % 4 == 0, F.to_json(F.struct(init.alias("raw")))).otherwise(init)
    triplets = F.array_join(F.flatten(F.transform("r", lambda x, i: F.array(x["l_linenumber"].cast("string"), text(vol(2, 1)(x, i)), text(vol(3, 0)(x, i))))), "|")
    update = F.to_json(F.struct(F.lit("UPDATE").alias("subcmd"), F.concat(F.lit("A|B|;|7|8||"), triplets).alias("recinfo")))
    raw = rows.select(F.col("l_suppkey").alias("id"), F.when(F.col("l_suppkey") % 2 == 0, init).otherwise(update).alias("raw"))
    flat = lambda c: F.transform(c, lambda x: F.array(x["price"], x["volume"])).alias(c)
    return parsers.book_payload(raw).select("id", "subcmd", "best_bid", "best_offer", flat("bids"), flat("offers"))


@query("s09_daily_stats", """
SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'C' || c_custkey END AS ticker, c_acctbal AS close, CAST(c_nationkey AS DOUBLE) AS vol, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS DOUBLE) END AS net_vol, CAST(NULL AS DOUBLE) AS freq FROM customer""")  # fmt: skip
def _(s, d):
    c = adapters.read(s, d, "customer")
    even, number = F.col("c_custkey") % 2 == 0, F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey").cast("string")).otherwise("-")
    long = F.struct(F.col("c_name").alias("kode"), F.col("c_acctbal").alias("close"), F.col("c_nationkey").alias("vol"), number.alias("net_vol"))
    short = F.struct(F.concat(F.lit("C"), F.col("c_custkey")).alias("t"), F.col("c_acctbal").cast("string").alias("c"), F.col("c_nationkey").alias("v"), number.alias("nv"))
    return parsers.daily_stats(c.select(F.when(even, F.to_json(long)).otherwise(F.to_json(short)).alias("raw"))).drop("raw")


# ---- symbols and hours ----


@query("p02_ticker_form", "SELECT p_partkey, regexp_matches(upper(p_brand), '^[A-Z0-9]{2,4}$') AS b, regexp_matches('T' || (p_partkey % 2000), '^[A-Z0-9]{2,4}$') AS ok FROM part")
def _(s, d):
    p = adapters.read(s, d, "part")
    return p.select("p_partkey", screens.is_ticker(F.upper("p_brand")).alias("b"), screens.is_ticker(F.concat(F.lit("T"), F.col("p_partkey") % 2000)).alias("ok"))


@query("p04_hour_limit", "SELECT instrument, date, count(*) AS candles, sum(vol)::BIGINT AS vol FROM c WHERE bucket < date + INTERVAL 15 HOUR GROUP BY ALL", "c")
def _(s, d):
    return bars(s, d).where(screens.up_to_hour("bucket", 14)).groupBy("instrument", "date").agg(F.count("*").alias("candles"), F.sum("vol").alias("vol"))


SYMBOLS = " click, purchase,click ,x1,view;LOGIN, signup "


@query("p12_parsed_symbols", "SELECT instrument, count(*) AS n FROM t WHERE upper(instrument) IN ('CLICK', 'SIGNUP') GROUP BY 1", "t")
def _(s, d):
    return ticks(s, d).where(F.upper("instrument").isin(*screens.symbol_list(SYMBOLS))).groupBy("instrument").agg(F.count("*").alias("n"))


# ---- sets with rows on both sides ----


@query("j14_feed_not_stored", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'A')")
def _(s, d):
    li = adapters.read(s, d, "lineitem")
    feed, stored = (li.where(F.col("l_returnflag") == k).select("l_suppkey", "l_partkey") for k in "RA")
    return feed.distinct().join(stored, ["l_suppkey", "l_partkey"], "left_anti")


@query("u07_expected_not_there", "SELECT * FROM ((SELECT DISTINCT l_suppkey AS broker, date_trunc('month', l_shipdate)::DATE AS date FROM lineitem) EXCEPT (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'R'))")
def _(s, d):
    t = adapters.read(s, d, "lineitem").withColumn("date", F.trunc("l_shipdate", "month"))
    there = t.where("l_linestatus = 'O' OR l_returnflag = 'R'")
    return t.select(F.col("l_suppkey").alias("broker"), "date").exceptAll(there.select("l_suppkey", "date")).distinct().subtract(there.select("l_suppkey", "date"))


@query("j16_fallback_by_time", """
, b AS (SELECT instrument, bucket, close FROM c WHERE date = DATE '2024-01-10'), fb AS (SELECT instrument, strftime(bucket, '%H:%M') AS hm, close FROM c WHERE date = DATE '2024-01-09')
SELECT b.instrument, strftime(b.bucket, '%H:%M') AS hm, b.close, fb.close AS fallback FROM b LEFT JOIN fb ON b.instrument = fb.instrument AND strftime(b.bucket, '%H:%M') = fb.hm""", "c")  # fmt: skip
def _(s, d):
    hm = F.date_format("bucket", "HH:mm").alias("hm")
    day = lambda x: bars(s, d).where(F.col("date") == F.lit(x).cast("date"))
    return day("2024-01-10").select("instrument", hm, "close").join(day("2024-01-09").select("instrument", hm, F.col("close").alias("fallback")), ["instrument", "hm"], "left")


@query("j10_precedence_chain", """
, k AS (SELECT instrument, date, close, lag(close) OVER w AS candle, CASE WHEN extract(day FROM date) % 3 = 0 THEN lag(vol) OVER w END AS bar, CASE WHEN extract(day FROM date) % 2 = 0 THEN lag(open) OVER w END AS tape FROM d WINDOW w AS (PARTITION BY instrument ORDER BY date))
SELECT instrument, date, CASE WHEN bar > 0 THEN CAST(bar AS DOUBLE) WHEN tape > 0 THEN tape WHEN candle > 0 THEN candle END AS previous,
  (close - CASE WHEN bar > 0 THEN CAST(bar AS DOUBLE) WHEN tape > 0 THEN tape WHEN candle > 0 THEN candle END) * 100 / CASE WHEN bar > 0 THEN CAST(bar AS DOUBLE) WHEN tape > 0 THEN tape WHEN candle > 0 THEN candle END AS growth FROM k""", "d")  # fmt: skip
def _(s, d):
    """An official bar exists every third day, a daily tape every second, the last candle always: stand-ins for three sources."""
    x = days(s, d)
    source = lambda rows, c, name: relational.as_of(x.select("instrument", "date"), rows.select("instrument", "date", F.col(c).cast("double").alias(name)), "instrument", "date", strict=True)
    day = F.dayofmonth("date")
    out = x.select("instrument", "date", "close")
    for c, name, there in (("vol", "bar", day % 3 == 0), ("open", "tape", day % 2 == 0), ("close", "candle", F.lit(True))):
        out = out.join(source(x, c, name).where(there), ["instrument", "date"], "left")
    return screens.growth_by_precedence(out, ["bar", "tape", "candle"]).select("instrument", "date", "previous", "growth")


# ---- table rules ----


@query("s05_upsert", "SELECT instrument, date, coalesce(n.vol, o.vol) AS vol FROM (SELECT instrument, date, vol FROM d WHERE candles < 20) o FULL JOIN (SELECT instrument, date, vol + 1 AS vol FROM d WHERE candles > 15) n USING (instrument, date)", "d")
def _(s, d):
    x = days(s, d).select("instrument", "date", "vol", "candles")
    return tables.upserted(x.where("candles < 20").drop("candles"), x.where("candles > 15").withColumn("vol", F.col("vol") + 1).drop("candles"), ["instrument", "date"])


@query("s07_backfill", "SELECT instrument, date, coalesce(o.vol, n.vol) AS vol FROM (SELECT instrument, date, vol FROM d WHERE candles < 20) o FULL JOIN (SELECT instrument, date, vol + 1 AS vol FROM d WHERE candles > 15) n USING (instrument, date)", "d")
def _(s, d):
    x = days(s, d).select("instrument", "date", "vol", "candles")
    return tables.upserted(x.where("candles < 20").drop("candles"), x.where("candles > 15").withColumn("vol", F.col("vol") + 1).drop("candles"), ["instrument", "date"], backfill=True)


@query("s10_last_trading_days", """
, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM d WHERE dayofweek(date) BETWEEN 1 AND 5))
SELECT instrument, date, vol, (SELECT max(i) FROM cal WHERE date <= DATE '2024-01-20') - i AS day_offset FROM d JOIN cal USING (date) WHERE day_offset BETWEEN 0 AND 4""", "d")  # fmt: skip
def _(s, d):
    x = days(s, d).select("instrument", "date", "vol")
    calendar = rolling.trading_calendar(ticks(s, d)).select("date", "day_index")
    return tables.last_days(x, calendar, F.lit("2024-01-20").cast("date"), 5)


@query("s11_by_priority", "SELECT instrument, date, arg_min(vol, p) AS vol FROM (SELECT instrument, date, vol * 3 AS vol, 1 AS p FROM d WHERE candles > 22 UNION ALL SELECT instrument, date, vol * 2, 2 FROM d WHERE candles > 18 UNION ALL SELECT instrument, date, vol, 3 FROM d) GROUP BY ALL", "d")
def _(s, d):
    x = days(s, d).select("instrument", "date", "vol", "candles")
    part = lambda least, by: x.where(F.col("candles") > least).select("instrument", "date", (F.col("vol") * by).alias("vol"))
    return tables.by_priority([part(22, 3), part(18, 2), part(0, 1)], ["instrument", "date"])


@query("s18_kept_since", "SELECT instrument, date, vol FROM d WHERE date >= DATE '2024-01-20' - 7", "d")
def _(s, d):
    return tables.kept_since(days(s, d).select("instrument", "date", "vol"), F.lit("2024-01-20").cast("date"), 7)


@query("s30_master_diff", "SELECT count(*) FILTER (c % 5 = 0) AS inserts, count(*) FILTER (c % 5 = 1) AS updates, count(*) FILTER (c % 5 > 2) AS skips, count(*) FILTER (c % 5 = 2) AS absents FROM (SELECT c_custkey AS c FROM customer)")
def _(s, d):
    c = adapters.read(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    old = c.where("c_custkey % 5 > 0")
    new = c.where("c_custkey % 5 <> 2").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 1, "moved").otherwise(F.col("c_mktsegment")))
    return tables.diff_counts(tables.master_diff(old, new, "c_custkey", ["c_name", "c_mktsegment"]))


@query("c17_guarded_summary", "SELECT instrument, date, 'FULL' AS source FROM d WHERE date = DATE '2024-01-10'", "d")
def _(s, d):
    x = days(s, d)
    day = lambda t: x.where(F.col("date") == F.lit(t).cast("date"))
    old = day("2024-01-10").select("instrument", "date", F.lit("FULL").alias("source"))
    # as many rows and none of them full: the old summary stays
    return tables.guarded(day("2024-01-11").select("instrument", "date", F.lit("ZSCORE").alias("source")), old)


# ---- order books ----

BOOKS = """WITH l AS (SELECT l_partkey AS id, l_linestatus = 'O' AS bid, CAST(CASE WHEN l_linestatus = 'O' THEN 1000 - l_linenumber ELSE 1000 + l_linenumber END AS DOUBLE) AS price, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id, bid ORDER BY CASE WHEN bid THEN -price ELSE price END) AS k FROM l),
b AS (SELECT id, max(price) FILTER (bid) AS bb, min(price) FILTER (NOT bid) AS bo, coalesce(sum(qty) FILTER (bid), 0) AS bq, coalesce(sum(qty) FILTER (NOT bid), 0) AS oq,
        coalesce(sum(qty) FILTER (bid AND k <= 5), 0) AS b5, coalesce(sum(qty) FILTER (NOT bid AND k <= 5), 0) AS o5 FROM r GROUP BY 1) """


def books(s, d):
    """A part's order book: open lines bid below 1,000, filled ones offer above it."""
    li = adapters.read(s, d, "lineitem")
    bid = F.col("l_linestatus") == "O"
    price = F.when(bid, 1000 - F.col("l_linenumber")).otherwise(1000 + F.col("l_linenumber")).cast("double")
    level = li.groupBy(F.col("l_partkey").alias("id"), bid.alias("bid"), price.alias("price")).agg(F.sum("l_quantity").alias("qty"))
    side = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.struct("price", "qty"))))
    return level.groupBy("id").agg(F.reverse(side(F.col("bid"))).alias("bids"), side(~F.col("bid")).alias("offers"))


@query("t09_book_intention", BOOKS + "SELECT id, (bq - oq) / (bq + oq) AS intention FROM b")
def _(s, d):
    return books(s, d).select("id", tape.book_intention(F.col("bids"), F.col("offers")).alias("intention"))


@query("t10_book_metrics", BOOKS + "SELECT id, round((bo - bb) * 10000 / ((bo + bb) / 2), 2) AS spread_bps, b5 AS bid_qty, o5 AS ask_qty, round((b5 - o5) / (b5 + o5), 6) AS imbalance FROM b")
def _(s, d):
    return tape.book_metrics(books(s, d)).select("id", "spread_bps", "bid_qty", "ask_qty", "imbalance")


@query("t11_latest_per_bucket", """
, x AS (SELECT instrument, ts, price, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY instrument, date_trunc('hour', ts) ORDER BY ts DESC) AS k FROM t),
y AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY h DESC) AS n FROM x WHERE k = 1) SELECT instrument, ts, price FROM y WHERE n <= 3""", "t")  # fmt: skip
def _(s, d):
    return tape.latest_per_bucket(ticks(s, d).select("instrument", "ts", "price"), "instrument", "ts", "hour")


@query("t17_intraday_summary", """
, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, seq DESC) AS k FROM t),
u AS (SELECT *, price > lag(price) OVER (PARTITION BY instrument ORDER BY ts, seq) AS up FROM k WHERE k <= 50),
a AS (SELECT instrument, sum(qty) AS vol, coalesce(sum(qty) FILTER (up), 0) AS up_vol, arg_max(price, (ts, seq)) AS last_price FROM u GROUP BY 1),
o AS (SELECT instrument, arg_max(open, date) AS day_open FROM d GROUP BY 1)
SELECT instrument, last_price, day_open, (last_price - day_open) * 100 / day_open AS change_pct, 0.6 * (CAST(up_vol AS DOUBLE) / vol) AS fused FROM a JOIN o USING (instrument) WHERE instrument IN ('click', 'login', 'purchase')""", "d")  # fmt: skip
def _(s, d):
    # a symbol of the roster without trades is left out
    roster = s.createDataFrame([("click",), ("login",), ("purchase",), ("none",)], "instrument string")
    opens = days(s, d).groupBy("instrument").agg(F.max_by("open", "date").alias("day_open"))
    return tape.intraday_summary(roster, ticks(s, d), opens).select("instrument", "last_price", "day_open", "change_pct", "fused")


@query("u05_first_of", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def _(s, d):
    li = adapters.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return relational.first_of(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")]).drop("l_extendedprice")


@query("p11_any_term", "SELECT p_partkey FROM part WHERE contains(upper(p_name), 'RING') OR contains(upper(p_name), 'BOLT')")
def _(s, d):
    return adapters.read(s, d, "part").where(relational.any_term("p_name", "ring, bolt")).select("p_partkey")


@query("p06_open_ranges", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_retailprice >= 950")
def _(s, d):
    inside = screens.between(F.col("p_size"), 10, 20) & screens.between(F.col("p_retailprice"), 950, None) & screens.between(F.col("p_size"), None, None)
    return adapters.read(s, d, "part").where(inside).select("p_partkey")


@query("p18_resolved_ohlc", """
SELECT instrument, bucket, coalesce(o, b) AS o, coalesce(h, greatest(coalesce(o, b), coalesce(cl, b))) AS h, least(coalesce(o, b), coalesce(cl, b)) AS l, coalesce(cl, b) AS c FROM (
  SELECT instrument, bucket, CASE WHEN trades % 2 = 0 THEN open END AS o, CASE WHEN trades % 3 = 0 THEN high END AS h, CASE WHEN trades % 5 > 0 THEN close END AS cl, low AS b FROM c)""", "c")  # fmt: skip
def _(s, d):
    n = F.col("trades")
    inner = F.struct(F.when(n % 2 == 0, F.col("open")).alias("o"), F.when(n % 3 == 0, F.col("high")).alias("h"), F.lit(None).cast("double").alias("l"), F.when(n % 5 > 0, F.col("close")).alias("c"))
    none = F.lit(None).cast("double")
    return bars(s, d).select("instrument", "bucket", screens.resolved_ohlc(inner, none, none, F.col("low")).alias("x")).select("instrument", "bucket", "x.*")


@query("a25_target_average", "SELECT l_partkey AS k, avg(CASE WHEN l_discount > 0 THEN l_discount ELSE l_tax END) AS target, count(*) AS n FROM lineitem WHERE l_discount > 0 OR l_tax > 0 GROUP BY 1")
def _(s, d):
    return screens.target_average(adapters.read(s, d, "lineitem").withColumnRenamed("l_partkey", "k"), "k", ["l_discount", "l_tax"])


@query("w20_interbroker", """
, k AS (SELECT *, sign(net)::INT AS s, first_value(sign(net)::INT) OVER (PARTITION BY ticker, broker ORDER BY date DESC) AS f FROM n),
r AS (SELECT *, min((s = f)::INT) OVER (PARTITION BY ticker, broker ORDER BY date DESC) AS run FROM k),
b AS (SELECT ticker, broker, sum(net) AS net, sum(buy + sell) AS total, max(f) * sum(run) AS streak FROM r GROUP BY ALL), a AS (SELECT count(DISTINCT date) AS days FROM n)
SELECT ticker, broker, CAST(abs(net) AS DOUBLE) / CAST(total AS DOUBLE) AS conviction, CAST(abs(net) AS DOUBLE) / CAST(sum(abs(net)) OVER (PARTITION BY ticker) AS DOUBLE) AS cr_pct,
  CAST(abs(streak) AS DOUBLE) / (SELECT days FROM a) AS persistence,
  CASE WHEN net = 0 OR count(*) OVER (PARTITION BY ticker) < 2 THEN 0 ELSE CAST(CASE WHEN net > 0 THEN count(*) FILTER (net > 0) OVER (PARTITION BY ticker) ELSE count(*) FILTER (net < 0) OVER (PARTITION BY ticker) END AS DOUBLE) / count(*) OVER (PARTITION BY ticker) END AS herd_pct FROM b""", "n")  # fmt: skip
def _(s, d):
    each = net(s, d)
    sums = each.groupBy("ticker", "broker").agg(F.sum("net").alias("net"), F.sum(F.col("buy") + F.col("sell")).alias("total"))
    days_ = each.select("date").distinct().agg(F.count("*").alias("active"))
    rows = sums.join(flows.signed_streak(each, ("ticker", "broker")), ["ticker", "broker"]).crossJoin(days_)  # one row
    return flows.interbroker(rows, F.col("active")).select("ticker", "broker", "conviction", "cr_pct", "persistence", "herd_pct")
