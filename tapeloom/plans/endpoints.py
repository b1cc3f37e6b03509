"""The analytic questions as functions; each takes canonical tables and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import activity, flows, relational, rolling, scans, scoring, screens, tape
from tapeloom.sources import publish


def footprint_summary(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Hybrid score per instrument and day; ``context`` (instrument, date, ctx_state, ctx_z) counts up to its date."""
    o = tape.order_flow(tape.day_rollup(bars))
    joined = relational.as_of(o, context, "instrument", "date")
    return scoring.hybrid_daily(joined.withColumn("ctx_found", F.col("ctx_state").isNotNull()))


def footprint_range(bars: DataFrame, context: DataFrame, start: Column, end: Column) -> DataFrame:
    """Hybrid score of a span of days, with the context from before it."""
    span = bars.where(F.col("date").between(start, end)).withColumn("date", start)
    o = tape.order_flow(tape.day_rollup(span))
    return scoring.hybrid_range(relational.as_of(o, context, "instrument", "date", strict=True))


def symbol(bars: DataFrame, levels: DataFrame, instrument: str, unit: str = "hour") -> DataFrame:
    """Candles of one instrument in wider buckets, with their levels."""
    mine = F.col("instrument") == instrument
    per = tape.rolled_levels(levels.where(mine), unit).groupBy("instrument", "bucket").agg(F.sort_array(F.collect_list(F.struct("p", "bv", "av"))).alias("levels"))
    return tape.rolled(bars.where(mine), unit).join(per, ["instrument", "bucket"], "left").orderBy("bucket")


def screener(flow: DataFrame, window: int = 20) -> DataFrame:
    """State and score of every ticker's newest day."""
    z = rolling.rolling_z(rolling.smart_money(flow), ("effort", "result", "ngr", "elas"), (window,))
    return relational.latest(rolling.regime(z).select("ticker", "date", "state", "score"), ["ticker"], "date").orderBy(F.desc_nulls_last("score"), "ticker")


def screener_accumulation(flow: DataFrame, windows: tuple = (2, 5, 10, 20), selected: tuple = (5,)) -> DataFrame:
    """Tickers with a positive smart net on every day of any selected window."""
    a = flows.accumulation_windows(flow, windows)
    return a.where(F.col("w").isin(*selected) & F.col("all_pos")).groupBy("ticker").agg(F.max("streak").alias("streak"), F.max("sm").alias("sm"))


def foreign_flow(flow: DataFrame) -> DataFrame:
    return flows.flow_trend(flow).orderBy(F.desc("score"), F.desc("slope"), "ticker")


def broker_range(trades: DataFrame, start: Column, end: Column, k: int = 20) -> DataFrame:
    """The first k net buyers and sellers of each ticker by lots."""
    n = flows.broker_net(trades.where(F.col("date").between(start, end)), ("ticker", "broker"))
    buyers = relational.top(n.where("net_lots > 0"), ["ticker"], [F.desc("net_lots"), F.asc("broker")], k).withColumn("list", F.lit("buyers"))
    sellers = relational.top(n.where("net_lots < 0"), ["ticker"], [F.asc("net_lots"), F.asc("broker")], k).withColumn("list", F.lit("sellers"))
    return buyers.unionByName(sellers)


def broker_activity(trades: DataFrame, broker) -> DataFrame:
    """One broker's stocks: totals, momentum and signed streak."""
    mine = trades.where(F.col("broker") == broker)
    daily = flows.broker_net(mine, ("ticker", "date"))
    totals = daily.groupBy("ticker").agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"), F.sum("net").alias("net"), F.count("*").alias("days"))
    return totals.join(activity.momentum(daily, ["ticker"]).drop("days"), "ticker").join(flows.signed_streak(daily, ("ticker",)), "ticker")


def event_feed(tables: dict[str, DataFrame], limit: int = 200, newest_first: bool = True) -> DataFrame:
    """Rows (id, moment, title) of several tables as one list."""
    out = None
    for kind, df in tables.items():
        df = df.select(F.lit(kind).alias("kind"), "id", "moment", "title")
        out = df if out is None else out.unionByName(df)
    return out.orderBy(F.col("moment").desc() if newest_first else F.col("moment"), "kind", "id").limit(limit)


def raw_history(bars: DataFrame, levels: DataFrame, timeline: DataFrame, now: Column, **session) -> DataFrame:
    """Candles of every day with its quality: those of the tape, or the day's timeline where the tape's day is sparse, cut or skeletal.

    ``timeline`` has flat candles (instrument, date, bucket, open .. close, vol,
    delta). ``completeness`` is that of the tape's day, ``is_fallback`` says
    that the timeline stands in, ``is_repairing`` that the day goes to repair:
    broken or incomplete days do, sparse ones do not.
    """
    bars = bars.withColumn("bucket", F.col("bucket").cast("timestamp"))
    levels, timeline = (x.withColumn("bucket", F.col("bucket").cast("timestamp")) for x in (levels, timeline))
    days = bars.groupBy("instrument", "date").agg(F.count_if(F.col("vol") > 0).alias("traded"), F.max(F.when(F.col("vol") > 0, F.col("bucket"))).alias("last_bucket"))
    days = days.withColumn("completeness", scoring.session_completeness(now, **session)).join(screens.skeletal(bars, levels), ["instrument", "date"], "left")
    broken = F.coalesce("broken", F.lit(False))
    state = days.select("instrument", "date", "completeness", broken.alias("broken"), (broken | ~F.col("completeness").isin("COMPLETE", "SPARSE_DATA", "NO_DATA")).alias("is_repairing"))
    columns = ["instrument", "date", "bucket", "open", "high", "low", "close", "vol", "delta"]
    whole = state.where((F.col("completeness") == "COMPLETE") & ~F.col("broken")).select("instrument", "date")
    other = timeline.select("instrument", "date").distinct()
    # a day stays with the tape if it is whole, or if there is nothing to stand in
    first = bars.select(columns).join(state.select("instrument", "date").join(other, ["instrument", "date"], "left_anti").union(whole).distinct(), ["instrument", "date"], "left_semi")
    second = timeline.select(columns).join(whole, ["instrument", "date"], "left_anti")
    out = first.withColumn("is_fallback", F.lit(False)).unionByName(second.withColumn("is_fallback", F.lit(True)))
    out = out.join(state, ["instrument", "date"], "left")
    return out.withColumns({"completeness": F.coalesce("completeness", F.lit("NO_DATA")), "broken": F.coalesce("broken", F.lit(False)), "is_repairing": F.coalesce("is_repairing", F.lit(True))})


def indicators(days: DataFrame, date: Column | None = None, instrument: str | None = None, limit: int = 20) -> DataFrame:
    """Averages, RSI and relative volume: of all instruments at a date, of one at a date, or of one's last ``limit`` days."""
    if date is None and instrument is None:
        raise ValueError("a date or an instrument is needed")
    d = days if instrument is None else days.where(F.col("instrument") == instrument)
    if date is not None:
        d = d.where(F.col("date") <= date)
    out = rolling.moving_averages(d)
    for n in (2, 5, 10, 20):
        out = rolling.relative_volume(out, n, "positions")
    out = out.join(scans.rsi_all(d).withColumnRenamed("rsi", "rsi_14"), ["instrument", "date"])
    return out.where(F.col("date") == date) if date is not None else relational.top(out, ["instrument"], [F.desc("date")], limit)


def published_summary(publication: publish.Publication, bars: DataFrame, context: DataFrame, calendar: DataFrame, today, holidays: tuple = (), enough: int = 100) -> DataFrame:
    """The published summary; if it is empty, or has no full rows and few others, the newest trading day of the last week recomputed.

    ``fallback`` tells which; the recomputed rows have cumulative delta and
    relative volume of the windows up to their day. ``bars`` is partitioned by
    date, so only the days of the windows are read.
    """
    now = publication.manifest()
    if now and now["rows"] and (now.get("full") or now["rows"] > enough):
        return publication.read().withColumn("fallback", F.lit(False))
    first = F.date_sub(F.lit(today), 7)
    skipped = F.dayofweek("date").isin(1, 7) | (F.col("date").isin(*holidays) if holidays else F.lit(False))
    day = bars.where((F.col("date") >= first) & (F.col("date") < F.lit(today)) & ~skipped).agg(F.max("date")).first()[0]
    if day is None:
        empty = footprint_range(bars, context, F.lit(today), F.lit(today)).limit(0)
        return empty.withColumn("fallback", F.lit(True))
    rows = footprint_range(bars, context, F.lit(day), F.lit(day))
    d = tape.day_rollup(bars.where(F.col("date") <= F.lit(day)))
    sums = rolling.lookback_sums(d, calendar).where(F.col("date") == F.lit(day)).select("instrument", *[f"cvd_{n}" for n in (2, 5, 10, 20)])
    for n in (2, 5, 10, 20):
        d = rolling.relative_volume(d, n, "positions")
    volumes = d.where(F.col("date") == F.lit(day)).select("instrument", *[f"rvol_{n}" for n in (2, 5, 10, 20)])
    return rows.join(sums, "instrument", "left").join(volumes, "instrument", "left").withColumn("fallback", F.lit(True))
