import pytest
from pyspark.sql import functions as F

from tapeloom.operators import screens


def test_ohlc_is_resolved_in_order(spark):
    schema = "ohlc struct<o:double,h:double,l:double,c:double>, open double, close double, price double"
    df = spark.createDataFrame([((1.0, 4.0, 0.5, 2.0), 9.0, 9.0, 9.0), ((None, None, None, 3.0), 5.0, None, None), (None, None, None, 7.0), (None, None, None, None)], schema)
    got = [tuple(r[0]) for r in df.select(screens.resolved_ohlc(*[F.col(c) for c in ("ohlc", "open", "close", "price")])).collect()]
    assert got == [(1, 4, 0.5, 2), (5, 5, 3, 3), (7, 7, 7, 7), (0, 0, 0, 0)]


def test_compact_map_falls_back(spark):
    df = spark.createDataFrame([({"5": 1.234, "10": 2.0},), ({"2": 0.5, "5": 1.0},)], "z map<string,double>")
    got = [r[0] for r in df.select(screens.compact_map(F.col("z"))).collect()]
    assert got == [{"2": 1.23, "5": 1.23, "10": 2.0}, {"2": 0.5, "5": 1.0}]


def test_snapshot_digest(spark):
    schema = "symbol string, ts int, price_last double, price_high double, price_low double, cvd_lot double, freq_tx double, levels array<struct<b_freq:double,s_freq:double>>"
    df = spark.createDataFrame([("A", 1, 100.0, 110.0, 90.0, 5.0, 3.0, None), ("A", 2, 105.0, 111.0, 90.0, 9.0, 4.0, [(2.0, 3.0), (None, 1.0)]), ("B", 1, 10.0, 1.0, 1.0, None, 8.0, [])], schema)
    got = {r.symbol: r for r in screens.snapshot_digest(df).collect()}
    a, b = got["A"], got["B"]
    assert (a.freq_tx, a.price_open, a.growth_pct, a.cvd_delta, a.snapshots) == (6, 100, 5, 4, 2)
    assert (b.freq_tx, b.growth_pct, b.cvd_delta) == (8, 0, None)


def test_target_average_takes_the_first_positive_alias(spark):
    df = spark.createDataFrame([("A", "0", "100"), ("A", "200", "1"), ("A", "x", None)], "t string, tp string, target string")
    r = screens.target_average(df, "t", ["tp", "target"]).first()
    assert (r.target, r.n) == (150, 2)


def test_sample_holds_the_mandatory_rows(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"))
    got = {r.k for r in screens.sample_with(rows, "k", 10, ("3", "4")).collect()}
    assert len(got) == 12 and {"3", "4"} <= got
    assert got == {r.k for r in screens.sample_with(rows.repartition(3), "k", 10, ("3", "4")).collect()}


def test_timeline_becomes_candles(spark):
    df = spark.createDataFrame([("A", [("09:00", 10.0, 100.0, 75.0), ("09:05", 11.0, None, None)])], "ticker string, timeline array<struct<t:string,p:double,dv:double,haka:double>>")
    assert [(r.t, r.close, r.vol, r.delta) for r in screens.timeline_candles(df).collect()] == [("09:00", 10, 100, 50), ("09:05", 11, 0, 0)]


@pytest.mark.parametrize("band,want", [("up2", [4, 3]), ("up1", [2, 1]), ("neutral", [0]), ("down1", [-1, -2]), ("down2", [-3, -4])])
def test_trend_bands(spark, band, want):
    df = spark.createDataFrame([(1, "T", 1, 1, t) for t in range(4, -5, -1)], "broker int, ticker string, net int, total int, trend int")
    assert [r.trend for r in screens.activity_filter(df, trend=band).collect()] == want
