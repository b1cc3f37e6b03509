"""Hand-made cases for operators that depend on order, ties and gaps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalars
from tapeloom.operators import flows, relational, rolling, scoring, tape


def trades(spark, rows, code="AADI"):
    """(second, price, qty) from 02:00 UTC."""
    base = dt.datetime(2026, 1, 6, 2)
    df = spark.createDataFrame([(code, base + dt.timedelta(seconds=s), i, float(p), q) for i, (s, p, q) in enumerate(rows)], "instrument string, ts timestamp_ntz, seq long, price double, qty long")
    return tape.bucketed(tape.valid(df), "minute")


SIX = [(10, 100, 10), (20, 101, 20), (50, 99, 30), (65, 100, 40), (90, 102, 50), (115, 101, 60)]


def test_minute_tick_rule_resets(spark):
    got = [tuple(r)[3:9] for r in tape.candles(tape.signed(trades(spark, SIX))).orderBy("bucket").collect()]
    assert got == [(100, 101, 99, 99, 60, -10), (100, 102, 100, 101, 150, -10)]


@pytest.mark.parametrize("qty,neutral,want", [(10, "split", (5, 5)), (11, "split", (5, 6)), (10, "drop", (0, 0))])
def test_neutral_trades(spark, qty, neutral, want):
    r = tape.levels(tape.signed(trades(spark, [(1, 100, qty)])), neutral).first()
    assert (r.bv, r.av) == want


@pytest.mark.parametrize("mode,prices,want", [("day_tick_carry", [100, 101, 101, 100, 100], [0, 1, 1, -1, -1]), ("vs_open", [100, 101, 100, 99], [0, 1, 0, -1]), ("recent_uptick", [100, 101, 101, 100], [0, 1, 0, 0])])
def test_signs(spark, mode, prices, want):
    got = tape.signed(trades(spark, [(i, p, 1) for i, p in enumerate(prices)]), mode).orderBy("seq").collect()
    assert [r.sign for r in got] == want


def test_rejects(spark):
    assert trades(spark, [(1, 100, 0), (2, float("nan"), 5), (3, -1, 5), (4, 7, 5)]).count() == 1


def test_volume_and_delta_invariants(spark):
    t = tape.signed(trades(spark, SIX))
    for r in tape.nested_candles(t).collect():
        assert abs(r.delta) <= r.vol and r.low <= min(r.open, r.close) and r.high >= max(r.open, r.close)
        assert sum(x.bv + x.av for x in r.levels) == r.vol


def test_book(spark):
    side = "array<struct<price:double,qty:double>>"
    df = spark.createDataFrame([([(99.0, 30.0), (98.0, 30.0)], [(101.0, 20.0)]), ([], [])], f"bids {side}, offers {side}")
    got = tape.book_metrics(df.withColumn("i", tape.book_intention(F.col("bids"), F.col("offers")))).collect()
    assert (got[0].spread_bps, got[0].imbalance, got[0].i) == (200.0, 0.5, 0.5)
    assert (got[1].imbalance, got[1].i) == (0.0, 0.0)


def test_latest_per_bucket(spark):
    df = spark.createDataFrame([("a", dt.datetime(2026, 1, 1, 0, m, s), m * 100 + s) for m in range(5) for s in (1, 30)], "k string, ts timestamp_ntz, v int")
    assert sorted(r.v for r in tape.latest_per_bucket(df, "k", "ts").collect()) == [230, 330, 430]


def dated(spark, values, column):
    return spark.createDataFrame([("T", "B", dt.date(2026, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], f"ticker string, broker string, date date, {column} double")


@pytest.mark.parametrize("net,want", [([2, -1, -5], -2), ([1, 1, 0], 0), ([3, 4], 2)])
def test_signed_streak(spark, net, want):
    assert flows.signed_streak(dated(spark, net, "net"), ("ticker", "broker")).first().streak == want


def test_accumulation_windows_are_strict(spark):
    d = dated(spark, [1, -1, 1, 1], "smart_net").withColumns({"foreign_net": F.col("smart_net"), "local_net": F.lit(0.0), "retail_net": F.lit(0.0), "price": F.lit(10)})
    got = {r.w: (r.streak, r.all_pos) for r in flows.accumulation_windows(d).collect()}
    assert got == {2: (2, True)}


def test_rolling_z(spark):
    got = rolling.rolling_z(dated(spark, [1, 2, 3, 10, 2], "x"), ("x",), (5,)).orderBy("date").collect()
    assert got[0].z_x_5 == 0
    assert got[3].z_x_5 == pytest.approx((10 - 4) / 3.5355339)
    assert got[4].z_x_5 == pytest.approx((2 - 3.6) / 3.2619013)


def test_relative_volume(spark):
    got = rolling.relative_volume(dated(spark, [10, 20, 30], "vol"), 2, key="ticker").orderBy("date").collect()
    assert [r.rvol_2 for r in got] == [None, None, 2.0]
    gaps = dated(spark, [10, 0, 30], "vol")
    assert rolling.relative_volume(gaps, 2, "positions", "ticker").orderBy("date").collect()[2].rvol_2 == 3.0
    assert rolling.relative_volume(gaps, 2, "calendar", "ticker").orderBy("date").collect()[2].rvol_2 == 3.0


def plain_rsi(c, n=14):
    c = c[-35:]
    d = [b - a for a, b in zip(c, c[1:])]
    if len(d) < n:
        return None
    g, l = (sum(max(s * x, 0) for x in d[:n]) / n for s in (1, -1))
    for x in d[n:]:
        g, l = (g * (n - 1) + max(x, 0)) / n, (l * (n - 1) + max(-x, 0)) / n
    return 100 if l == 0 else 100 - 100 / (1 + g / l)


@pytest.mark.parametrize("closes", [list(range(15)), list(range(14)), [5 + (i * 7 % 11) for i in range(60)]])
def test_rsi(spark, closes):
    got = rolling.rsi(dated(spark, closes, "close"), key="ticker").first().rsi
    want = plain_rsi([float(x) for x in closes])
    assert got == (None if want is None else pytest.approx(want))


def test_percentiles(spark):
    df = spark.createDataFrame([(1, "d"), (2, "d"), (2, "d"), (4, "d"), (9, "e"), (None, "d")], "v int, g string")
    got = df.select("v", "g", rolling.mid_rank(F.col("v"), ["g"]).alias("m"), rolling.average_rank(F.col("v"), ["g"], 0.3).alias("a")).collect()
    assert sorted((r.m, r.a) for r in got if r.g == "d" and r.v) == [(0.125, 0), (0.5, 0.5), (0.5, 0.5), (0.875, 1)]
    assert [(r.m, r.a) for r in got if r.g == "e"] == [(0.5, 0.5)]
    assert [(r.m, r.a) for r in got if r.v is None] == [(None, 0.3)]


def test_classifiers_disagree(spark):
    df = spark.createDataFrame([("Retail", "Asing")], "c string, t string")
    got = df.select(*[scalars.flow_group(F.col("c"), F.col("t"), v).alias(v) for v in ("flow", "range", "mvp", "smart")]).first()
    assert tuple(got) == ("foreign", "retail", "foreign", "foreign")


@pytest.mark.parametrize("state,delta,z,want", [("DISTRIBUTION", 6, 0, 0.5), ("ACCUMULATION", -6, 0, 0.7), ("ACCUMULATION", 6, 0.6, 1.2), ("NEUTRAL", 50, 2, 1.0)])
def test_divergence(spark, state, delta, z, want):
    df = spark.createDataFrame([(state, float(delta), float(z))], "s string, d double, z double")
    assert df.select(scoring.divergence_factor(F.col("s"), F.col("d"), F.col("z"))).first()[0] == want


def test_upper_median_quadrants(spark):
    rows = [(b, f"T{i}", 1.0, 1.0, 0.0) for b, n in ((1, 1), (2, 2), (3, 3), (4, 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "broker int, ticker string, net double, buy double, sell double")
    assert {r.broker: (r.median, r.quadrant) for r in flows.breadth_quadrants(df).collect()} == {1: (3, "Q4"), 2: (3, "Q4"), 3: (3, "Q1"), 4: (3, "Q1")}


def test_calendar_skips_weekends_and_holidays(spark):
    days = spark.createDataFrame([(dt.date(2026, 2, 10) + dt.timedelta(days=i),) for i in range(12)], "date date")
    got = {r.date: r.previous for r in rolling.trading_calendar(days, ("2026-02-16", "2026-02-17")).collect()}
    assert got[dt.date(2026, 2, 18)] == dt.date(2026, 2, 13)


def test_as_of(spark):
    day = lambda n: dt.date(2026, 1, n)
    left = spark.createDataFrame([("a", day(1)), ("a", day(5)), ("b", day(5))], "k string, date date")
    right = spark.createDataFrame([("a", day(1), 10), ("a", day(4), 20), ("a", day(6), 30)], "k string, date date, v int")
    for strict, want in ((False, [10, 20, None]), (True, [None, 20, None])):
        assert [r.v for r in relational.as_of(left, right, "k", "date", strict).orderBy("k", "date").collect()] == want


def test_half_up(spark):
    got = spark.range(1).select(*[scalars.half_up(F.lit(x)) for x in (-2.5, 2.5, -0.4)]).first()
    assert tuple(got) == (-2.0, 3.0, 0.0)


def test_quality_and_search(spark):
    rows = [(10, 1, 1, 5.0, 10, 3), (0, 1, 1, 5.0, 10, 3), (None, 1, 1, 5.0, 10, 3), (10, 0, 1, 5.0, 10, 3), (10, 1, None, 5.0, 10, 3), (10, 0, 0, 5.0, 10, 3), (10, 1, 1, 0.0, 10, 3), (10, 1, 1, 0.0, 10, 0), (10, 1, 1, 5.0, 5, 3), (10, 1, 1, 5.0, 0, 3), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "price int, buyers int, sellers int, total_value double, prev_price int, freq int")
    got = [(r.issues, r.severity) for r in scoring.quality_issues(df).collect()]
    assert got == [
        ([], "OK"),
        (["NO_PRICE"], "CRITICAL"),
        (["NO_PRICE"], "CRITICAL"),
        (["NO_BUYERS"], "CRITICAL"),
        (["NO_SELLERS"], "CRITICAL"),
        (["NO_BUYERS", "NO_SELLERS", "VALUE_WITHOUT_BROKERS"], "CRITICAL"),
        (["FREQUENCY_WITHOUT_VALUE"], "CRITICAL"),
        ([], "OK"),
        (["PRICE_JUMP"], "WARNING"),
        ([], "OK"),
        (["NO_PRICE", "NO_BUYERS", "NO_SELLERS"], "CRITICAL"),
    ]
    names = spark.createDataFrame([("Alpha", "x"), ("beta", "x"), ("alpine", "y")], "name string, status string")
    assert [r.name for r in relational.search(names, "AL%", "name", status="x").collect()] == ["Alpha"]
    assert {r.name for r in names.where(relational.any_term("name", "bet, pin")).collect()} == {"beta", "alpine"}


def test_session_completeness(spark):
    at = lambda h, m, d=5: dt.datetime(2026, 1, d, h, m)
    rows = [(5, 80, at(8, 0)), (5, 80, at(7, 30)), (5, 20, at(8, 5)), (5, 0, None), (2, 84, at(8, 55, 2)), (2, 84, at(8, 40, 2)), (2, 41, at(8, 55, 2))]
    df = spark.createDataFrame([(dt.date(2026, 1, d), n, t) for d, n, t in rows], "date date, traded int, last_bucket timestamp")
    state = lambda now: [r.s for r in df.select(scoring.session_completeness(F.lit(now).cast("timestamp"), 120, 540).alias("s")).collect()]
    past = ["COMPLETE", "PAST_DAY_INCOMPLETE", "SPARSE_DATA"]
    assert state("2026-01-05 08:10:00") == ["COMPLETE", "TODAY_STALE", "SPARSE_DATA", "NO_DATA", *past]
    # before the open nothing is expected, after the close nothing is stale
    assert state("2026-01-05 01:00:00")[:4] == ["COMPLETE", "COMPLETE", "COMPLETE", "NO_DATA"]
    assert state("2026-01-05 12:00:00")[:4] == ["COMPLETE", "COMPLETE", "SPARSE_DATA", "NO_DATA"]


def test_minute_tick_rule_and_reset(spark):
    at = lambda m, s: dt.datetime(2026, 1, 5, 2, m, s)
    rows = [("A", at(0, 10), 1, 100.0, 10), ("A", at(0, 20), 2, 101.0, 20), ("A", at(0, 50), 3, 99.0, 30), ("A", at(1, 5), 4, 100.0, 40), ("A", at(1, 30), 5, 102.0, 50), ("A", at(1, 55), 6, 101.0, 60)]
    ticks = spark.createDataFrame(rows, "instrument string, ts timestamp, seq long, price double, qty long")
    minute = tape.candles(tape.signed(tape.bucketed(ticks, "minute")))
    got = [(r.open, r.high, r.low, r.close, r.vol, r.delta) for r in minute.orderBy("bucket").collect()]
    assert got == [(100, 101, 99, 99, 60, -10), (100, 102, 100, 101, 150, -10)]
    five = tape.rolled(minute, "5 minutes").collect()
    assert [(r.open, r.high, r.low, r.close, r.vol, r.delta) for r in five] == [(100, 102, 99, 101, 210, -20)]


def test_probability_of_missing_and_stale_inputs(spark):
    names = ["sm2", "sm5", "sm10", "order_mom_pct", "order_delta_pct", "order_absorb", "order_cvd", "eff2", "eff5", "netv"]
    rows = [(f"T{i}", "NEUTRAL" if i else "DISTRIBUTION", i != 3, *[float(i)] * len(names)) for i in range(8)]
    rows.append(("T8", "NEUTRAL", True, *[None if n == "order_mom_pct" else 9.0 for n in names]))
    df = spark.createDataFrame(rows, "ticker string, state string, fresh boolean, " + ", ".join(f"{n} double" for n in names)).withColumn("date", F.lit(1))
    got = {r.ticker: r for r in scoring.two_day_probability(df, ["date"], F.col("fresh")).collect()}
    assert (got["T0"].tom2, got["T0"].tom2_raw, got["T0"].tom2_label) == (5, 0, "DISQ")
    assert [(got[t].tom2, got[t].tom2_raw, got[t].tom2_label) for t in ("T3", "T8")] == [(None, None, "NA")] * 2
    assert 5 <= got["T1"].tom2 < got["T7"].tom2 <= 90
