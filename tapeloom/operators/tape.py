"""Trades to candles: signed volume, levels, roll-ups and the day's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import clamp, ratio

#: How trades get a sign; see :func:`signed`.
MODES = ("minute_tick", "day_tick_carry", "recent_uptick", "vs_open")


def valid(ticks: DataFrame) -> DataFrame:
    """Trades with an instrument, a finite price above 0 and a quantity above 0."""
    price = F.col("price")
    return ticks.where(F.col("instrument").isNotNull() & (F.col("instrument") != "") & price.isNotNull() & ~F.isnan(price) & (price > 0) & (F.col("qty") > 0))


def floored(ts: str | Column, width: str) -> Column:
    """Start of the bucket that holds ``ts``: ``width`` is a unit of the calendar (hour, day) or a duration (5 minutes)."""
    return F.window(ts, width).getField("start") if " " in width else F.date_trunc(width, ts)


def in_session(ts: Column, date: Column, now: Column, opens: str = "02:00", closes: str = "09:00") -> Column:
    """Within the session of ``date``, ends included; the session of today ends now, if it has not closed yet."""
    at = lambda clock: F.to_timestamp(F.concat(date.cast("string"), F.lit(f" {clock}:00")))
    end = F.when(date == F.to_date(now), F.greatest(at(opens), F.least(now, at(closes)))).otherwise(at(closes))
    return ts.between(at(opens), end)


def bucketed(ticks: DataFrame, width: str = "hour") -> DataFrame:
    return ticks.withColumn("date", F.to_date("ts")).withColumn("bucket", floored("ts", width))


def signed(ticks: DataFrame, mode: str = "minute_tick") -> DataFrame:
    """Add ``sign`` (-1, 0, 1) to bucketed trades, in the order of (ts, seq).

    minute_tick: against the trade before in the bucket; the first is neutral.
    day_tick_carry: against the trade before of the day; an equal price keeps
    the last direction. recent_uptick: 1 for upticks of the day, else 0.
    vs_open: against the bucket's first price.
    """
    bucket = W.partitionBy("instrument", "bucket").orderBy("ts", "seq")
    day = W.partitionBy("instrument", "date").orderBy("ts", "seq")
    price = F.col("price")
    if mode == "minute_tick":
        sign = F.signum(price - F.lag(price).over(bucket))
    elif mode == "day_tick_carry":
        moved = ticks.withColumn("_m", F.nullif(F.signum(price - F.lag(price).over(day)), F.lit(0.0)))
        return moved.withColumn("sign", F.coalesce(F.last("_m", ignorenulls=True).over(day), F.lit(0.0)).cast("int")).drop("_m")
    elif mode == "recent_uptick":
        sign = F.when(price > F.lag(price).over(day), 1.0)
    elif mode == "vs_open":
        sign = F.signum(price - F.first("price").over(bucket))
    else:
        raise ValueError(mode)
    return ticks.withColumn("sign", F.coalesce(sign, F.lit(0.0)).cast("int"))


def candles(trades: DataFrame, keys: tuple = ("instrument", "date", "bucket")) -> DataFrame:
    """OHLC, vol and delta by ``keys``, from signed trades: one aggregate, no look-up joins."""
    at = F.struct("ts", "seq")
    return trades.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("vol"),
        F.sum(F.col("qty") * F.col("sign")).alias("delta"),
        F.count("*").alias("trades"),
    )


def levels(trades: DataFrame, neutral: str = "split", keys: tuple = ("instrument", "bucket")) -> DataFrame:
    """Volume bought and sold at each price. Neutral trades are split (half, rounded down, to the buyers) or dropped."""
    half = F.floor(F.col("qty") / 2).cast("long") if neutral == "split" else F.lit(0)
    rest = F.col("qty") - half if neutral == "split" else F.lit(0)
    buy = F.when(F.col("sign") > 0, F.col("qty")).when(F.col("sign") < 0, 0).otherwise(half)
    sell = F.when(F.col("sign") < 0, F.col("qty")).when(F.col("sign") > 0, 0).otherwise(rest)
    return trades.groupBy(*keys, F.col("price").alias("p")).agg(F.sum(buy).alias("bv"), F.sum(sell).alias("av"))


def nested_candles(trades: DataFrame, neutral: str = "split") -> DataFrame:
    """Candles with their levels as an array sorted by price."""
    per = levels(trades, neutral).groupBy("instrument", "bucket").agg(F.sort_array(F.collect_list(F.struct("p", "bv", "av"))).alias("levels"))
    return candles(trades).join(per, ["instrument", "bucket"])


def rolled(bars: DataFrame, width: str) -> DataFrame:
    """Candles of a longer bucket: first open, last close, extremes and sums."""
    b = bars.withColumn("wide", floored("bucket", width))
    return b.groupBy("instrument", F.col("wide").alias("bucket")).agg(
        F.min_by("open", "bucket").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bucket").alias("close"),
        F.sum("vol").alias("vol"),
        F.sum("delta").alias("delta"),
    )


def rolled_levels(level_rows: DataFrame, width: str) -> DataFrame:
    wide = level_rows.withColumn("bucket", floored("bucket", width))
    return wide.groupBy("instrument", "bucket", "p").agg(F.sum("bv").alias("bv"), F.sum("av").alias("av"))


def day_rollup(bars: DataFrame) -> DataFrame:
    """Candles of a day in one row: sums, extremes, first and last, count and times."""
    return bars.groupBy("instrument", "date").agg(
        F.min_by("open", "bucket").alias("open"),
        F.max_by("close", "bucket").alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("vol").alias("vol"),
        F.sum("delta").alias("delta"),
        F.count("*").alias("candles"),
        F.min("bucket").alias("first_bucket"),
        F.max("bucket").alias("last_bucket"),
    )


def quadrant(x: Column, y: Column) -> Column:
    return F.when((x >= 0) & (y >= 0), "Q1").when((x < 0) & (y >= 0), "Q2").when((x < 0) & (y < 0), "Q3").otherwise("Q4")


def order_flow(day: DataFrame) -> DataFrame:
    """Delta and price change in per cent, absorption and quadrant of day rows."""
    d = ratio(F.col("delta") * 100, F.col("vol"))
    p = ratio((F.col("close") - F.col("open")) * 100, F.col("open"))
    out = day.withColumn("delta_pct", d).withColumn("price_pct", p)
    out = out.withColumn("absorption", F.abs("delta_pct") / (1 + F.abs("price_pct")))
    return out.withColumn("quadrant", quadrant(F.col("delta_pct"), F.col("price_pct")))


def day_timeline(bars: DataFrame, shares_per_lot: int = 100) -> DataFrame:
    """Running value, momentum, absorption and aggressor balance, candle by candle."""
    day = W.partitionBy("instrument", "date")
    run = day.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    t = bars.withColumn("day_open", F.first("open").over(day.orderBy("bucket")))
    span = F.max("high").over(day) - F.min("low").over(day)
    t = t.withColumn("value", F.col("vol") * F.col("close").cast("decimal(18,2)") * shares_per_lot)
    t = t.withColumn("cum_value", F.sum("value").over(run)).withColumn("cum_vol", F.sum("vol").over(run))
    t = t.withColumn("momentum", F.coalesce(ratio((F.col("close") - F.col("day_open")) * 100, F.col("day_open")), F.lit(0.0)))
    t = t.withColumn("absorption", F.when(span > 0, F.col("cum_vol") / span).otherwise(F.col("cum_vol").cast("double")))
    t = t.withColumn("haka", (F.coalesce(ratio(F.col("delta"), F.col("vol")), F.lit(0.0)) + 1) * 50)
    t = t.withColumn("x", F.col("haka") - 50)
    return t.withColumn("q", quadrant(F.col("x"), F.col("momentum")))


def day_summary(bars: DataFrame) -> DataFrame:
    """One row per instrument and day: totals, quadrant profile and hidden accumulation."""
    t = day_timeline(bars)
    s = t.groupBy("instrument", "date").agg(
        F.min_by("open", "bucket").alias("open"),
        F.max_by("close", "bucket").alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("vol").alias("vol"),
        F.sum("trades").alias("freq"),
        F.sum("delta").alias("net_vol"),
        F.max("cum_value").cast("double").alias("val"),
        F.max_by("momentum", "bucket").alias("momentum"),
        *[F.count_if(F.col("q") == q).alias(q.lower()) for q in ("Q1", "Q2", "Q3", "Q4")],
        F.sum(F.when(F.col("q") == "Q4", F.col("vol")).otherwise(0)).alias("q4_vol"),
    )
    flow = F.coalesce(ratio(F.col("net_vol"), F.col("vol")), F.lit(0.0))
    s = s.withColumn("money_flow", flow).withColumn("q4_ratio", ratio(F.col("q4"), F.col("q1") + F.col("q2") + F.col("q3") + F.col("q4")))
    return s.withColumn("hidden_acc", F.col("q4_ratio") * ratio(F.col("q4_vol"), F.col("vol")) * F.greatest("money_flow", F.lit(0.0)))


def realtime_signal(trades: DataFrame, last: int = 50, intention: Column | float = 0.0, cap: float = 0.05) -> DataFrame:
    """Signal from each instrument's last trades: share of uptick volume, momentum, fused score and side."""
    newest = W.partitionBy("instrument").orderBy(F.desc("ts"), F.desc("seq"))
    t = trades.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last)
    oldest = W.partitionBy("instrument").orderBy("ts", "seq")
    t = t.withColumn("_up", F.col("price") > F.lag("price").over(oldest))
    at = F.struct("ts", "seq")
    s = t.groupBy("instrument").agg(
        F.sum("qty").alias("vol"),
        F.sum(F.when(F.col("_up"), F.col("qty")).otherwise(0)).alias("up_vol"),
        F.min_by("price", at).alias("first_price"),
        F.max_by("price", at).alias("last_price"),
        F.count("*").alias("n"),
    )
    s = s.withColumn("haka_ratio", ratio(F.col("up_vol"), F.col("vol")))
    change = ratio(F.col("last_price") - F.col("first_price"), F.col("first_price"))
    s = s.withColumn("momentum", clamp(change, -cap, cap) / cap)
    fused = 0.6 * F.col("haka_ratio") + 0.4 * (intention if isinstance(intention, Column) else F.lit(intention))
    s = s.withColumn("fused", fused)
    return s.withColumn("side", F.when(F.col("fused") > 0.2, "BUY").when(F.col("fused") < -0.2, "SELL").otherwise("NEUTRAL"))


def intraday_summary(roster: DataFrame, trades: DataFrame, opens: DataFrame, last: int = 50) -> DataFrame:
    """The realtime signal of every symbol of the roster (instrument) with day_open and the change since; tradeless symbols are left out."""
    s = realtime_signal(trades.join(roster, "instrument", "left_semi"), last).join(opens, "instrument", "left")
    return s.withColumn("change_pct", ratio((F.col("last_price") - F.col("day_open")) * 100, F.col("day_open")))


def book_intention(bids: Column, offers: Column) -> Column:
    """(bid quantity - offer quantity) / total, of arrays of (price, qty); 0 for an empty book."""
    total = lambda side: F.aggregate(side, F.lit(0.0), lambda a, x: a + x["qty"])
    b, o = total(bids), total(offers)
    return F.coalesce(ratio(b - o, b + o), F.lit(0.0))


def book_metrics(books: DataFrame, depth: int = 5) -> DataFrame:
    """Spread in basis points, quantities of the first levels and their imbalance."""
    top = lambda side: F.aggregate(F.slice(side, 1, depth), F.lit(0.0), lambda a, x: a + x["qty"])
    bid, ask = F.get("bids", 0)["price"], F.get("offers", 0)["price"]
    out = books.withColumn("spread_bps", F.round(ratio((ask - bid) * 10_000, (ask + bid) / 2), 2))
    out = out.withColumn("bid_qty", top("bids")).withColumn("ask_qty", top("offers"))
    return out.withColumn("imbalance", F.round(F.coalesce(ratio(F.col("bid_qty") - F.col("ask_qty"), F.col("bid_qty") + F.col("ask_qty")), F.lit(0.0)), 6))


def latest_per_bucket(rows: DataFrame, key: str, ts: str, unit: str = "minute", keep: int = 3) -> DataFrame:
    """The last row of each bucket, the newest ``keep`` buckets of each key."""
    last = rows.groupBy(key, F.date_trunc(unit, F.col(ts)).alias("_b")).agg(F.max_by(F.struct("*"), ts).alias("_r"))
    newest = W.partitionBy(key).orderBy(F.desc("_b"))
    return last.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= keep).select("_r.*")


def value_area(level_rows: DataFrame, share: float = 0.7) -> DataFrame:
    """Point of control and the price range that holds ``share`` of a bucket's volume, by falling volume."""
    v = level_rows.withColumn("v", F.col("bv") + F.col("av"))
    key = W.partitionBy("instrument", "bucket")
    order = key.orderBy(F.desc("v"), "p").rowsBetween(W.unboundedPreceding, -1)
    v = v.withColumn("total", F.sum("v").over(key)).withColumn("before", F.coalesce(F.sum("v").over(order), F.lit(0)))
    inside = F.col("before") < share * F.col("total")
    return v.groupBy("instrument", "bucket").agg(
        F.max_by("p", F.struct(F.col("v"), -F.col("p"))).alias("poc"), F.min(F.when(inside, F.col("p"))).alias("val"), F.max(F.when(inside, F.col("p"))).alias("vah")
    )
