"""Endpoint functions give the values of the queries that do the same, and the published summary falls back as it should."""

import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import flows, rolling, tape
from tapeloom.plans import endpoints
from tapeloom.plans import queries as q
from tapeloom.sources import adapters, publish

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_symbol_is_the_rollup_of_one_instrument(spark):
    bars, levels = q.bars(spark, SF), tape.levels(q.signed(spark, SF))
    got = endpoints.symbol(bars, levels, "view", "day")
    want = q.days(spark, SF).where("instrument = 'view'")
    cells = ("open", "high", "low", "close", "vol", "delta")
    assert rows(got, F.to_date("bucket").alias("date"), *cells) == rows(want, "date", *cells) != []
    held = got.select("vol", F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + x["bv"] + x["av"]).alias("held")).collect()
    assert all(r.vol == r.held for r in held)


def test_screeners_and_flows_agree_with_their_operators(spark):
    flow, trades = q.flow(spark, SF), adapters.broker_trades(spark, SF)
    newest = {r.ticker: r.date for r in flow.groupBy("ticker").agg(F.max("date").alias("date")).collect()}
    regimes = {(r.ticker, r.date): (r.state, r.score) for r in q.regimes(spark, SF).collect()}
    got = endpoints.screener(flow).collect()
    assert {r.ticker: r.date for r in got} == newest and all(regimes[r.ticker, r.date] == (r.state, r.score) for r in got)
    scores = [r.score for r in got if r.score is not None]
    assert scores == sorted(scores, reverse=True)
    windows = flows.accumulation_windows(flow, (2, 5, 10, 20)).where("w = 2 AND all_pos").select("ticker").distinct()
    found = endpoints.screener_accumulation(flow, selected=(2,))
    assert rows(found, "ticker") == rows(windows, "ticker")
    start, end = F.lit("1995-01-01").cast("date"), F.lit("2001-01-01").cast("date")
    net = flows.broker_net(trades.where(F.col("date").between(start, end)), ("ticker", "broker")).where("net_lots <> 0")
    both = endpoints.broker_range(trades, start, end, k=1000)
    assert rows(both, "ticker", "broker", "net_lots") == rows(net, "ticker", "broker", "net_lots") != []
    first = endpoints.broker_range(trades, start, end, k=1).where("list = 'buyers'").select("ticker", "net_lots")
    assert rows(first, "ticker", "net_lots") == rows(net.where("net_lots > 0").groupBy("ticker").agg(F.max("net_lots").alias("net_lots")), "ticker", "net_lots")
    mine = endpoints.broker_activity(trades, 1)
    assert rows(mine, "ticker", "net") == rows(flows.broker_net(trades.where("broker = 1"), ("ticker",)), "ticker", "net") != []


def test_indicators_by_date_and_by_instrument(spark):
    days = q.days(spark, SF)
    date = F.lit("2024-01-26").cast("date")
    by_date = endpoints.indicators(days, date)
    one = endpoints.indicators(days, instrument="view", limit=7)
    names = ("ma_5", "ma_20", "rvol_5", "rsi_14")
    assert one.count() == 7 and rows(one.where(F.col("date") == date), *names) == rows(by_date.where("instrument = 'view'"), *names) != []
    assert rows(endpoints.indicators(days, date, "view"), "date", *names) == rows(by_date.where("instrument = 'view'"), "date", *names)
    assert rows(by_date, "instrument", "ma_5") == rows(rolling.moving_averages(days).where(F.col("date") == date), "instrument", "ma_5")
    with pytest.raises(ValueError):
        endpoints.indicators(days)


def test_raw_history_stands_in_for_broken_days_only(spark):
    at = lambda t: datetime.datetime.fromisoformat(f"2024-01-{t}")
    whole = [("A", f"10T{h:02d}:00", 10) for h in range(2, 9)] + [("A", "11T02:00", 10), ("B", "10T02:00", 10)]
    bars = spark.createDataFrame([(k, at(t), 1.0, 2.0, 1.0, 2.0, v, 1) for k, t, v in whole], "instrument string, bucket timestamp, open double, high double, low double, close double, vol long, delta long").withColumn("date", F.to_date("bucket"))
    levels = bars.select("instrument", "bucket", F.lit(1.0).alias("p"), F.lit(5).alias("bv"), F.lit(5).alias("av"))
    flat = bars.where("instrument = 'A'").withColumn("vol", F.lit(7).cast("long")).withColumn("open", F.lit(9.0))
    flat = flat.unionByName(flat.where("hour(bucket) = 3").withColumn("instrument", F.lit("C")))
    kw = dict(now=F.lit("2024-01-20 05:00:00").cast("timestamp"), opens=120, closes=540, width=60, early=60)
    get = lambda lv: {(r.instrument, r.date.day): (r.completeness, r.broken, r.is_fallback, r.is_repairing, r.n, r.vol) for r in endpoints.raw_history(bars, lv, flat, **kw).groupBy("instrument", "date", "completeness", "broken", "is_fallback", "is_repairing").agg(F.count("*").alias("n"), F.max("vol").alias("vol")).collect()}
    assert get(levels) == {("A", 10): ("COMPLETE", False, False, False, 7, 10), ("A", 11): ("SPARSE_DATA", False, True, False, 1, 7), ("B", 10): ("SPARSE_DATA", False, False, False, 1, 10), ("C", 10): ("NO_DATA", False, True, True, 1, 7)}
    skeletal = get(levels.where("NOT (instrument = 'A' AND hour(bucket) = 4)"))
    assert skeletal["A", 10] == ("COMPLETE", True, True, True, 7, 7)


def test_published_summary_falls_back_to_the_newest_trading_day(spark, tmp_path):
    bars = q.bars(spark, SF)
    context = q.days(spark, SF).select("instrument", "date", F.lit("ACCUMULATION").alias("ctx_state"), F.lit(1.0).alias("ctx_z"))
    calendar = rolling.trading_calendar(bars.select("date"))
    monday = datetime.date(2024, 1, 29)
    place = publish.Publication(spark, f"file://{tmp_path}/s")
    got = endpoints.published_summary(place, bars, context, calendar, monday).collect()
    friday = F.lit("2024-01-26").cast("date")
    want = endpoints.footprint_range(bars, context, friday, friday)
    assert all(r.fallback for r in got) and sorted((r.instrument, r.score) for r in got) == sorted((r.instrument, r.score) for r in want.collect())
    sums = rolling.lookback_sums(q.days(spark, SF), calendar).where(F.col("date") == friday)
    assert {r.instrument: (r.cvd_2, r.cvd_20) for r in got} == {r.instrument: (r.cvd_2, r.cvd_20) for r in sums.collect()}
    assert endpoints.published_summary(place, bars, context, calendar, datetime.date(2024, 3, 1)).count() == 0
    summary = spark.createDataFrame([("A", "ZSCORE")], "instrument string, source string")
    publish.publish_summary(place, summary, "instrument", True)
    assert endpoints.published_summary(place, bars, context, calendar, monday).count() == len(got)  # scores of few rows alone
    publish.publish_summary(place, summary.withColumn("source", F.lit("FULL")), "instrument", True)
    assert [tuple(r) for r in endpoints.published_summary(place, bars, context, calendar, monday).collect()] == [("A", "FULL", False)]
