import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import activity, scoring
from tapeloom.plans import endpoints
from tapeloom.sources import parsers, tables


def clip(x, a, b):
    return max(a, min(b, x))


def norm(x, a, b):
    return clip((x - a) / (b - a) * 100, 0, 100)


def plain_pressure(rows):
    """(bid5, ask5, bid) of one window, oldest first -> (bss, ats)."""
    n = len(rows)
    pairs = list(zip(rows, rows[1:]))
    share = lambda f: sum(map(f, pairs)) / (n - 1)
    change = lambda k: (rows[-1][k] - rows[0][k]) / rows[0][k] * 100 if rows[0][k] > 0 else 0
    median = sorted(r[1] for r in rows)[n // 2] or 1
    walls = sum(b[1] > a[1] and b[1] >= 1.5 * median for a, b in pairs)
    bss = 0.45 * norm(change(0), -10, 40) + 0.35 * norm(share(lambda p: p[1][0] > p[0][0]), 0, 1.2) + 0.2 * norm(share(lambda p: p[1][2] == p[0][2]), 0.2, 1)
    ats = 0.45 * norm(-change(1), -10, 40) + 0.35 * norm(share(lambda p: p[1][1] < p[0][1]), 0, 1.2) + 0.2 * (100 - clip(walls / (n - 1) * 200, 0, 100))
    return clip(bss, 0, 100), clip(ats, 0, 100)


def test_book_pressure(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(0, 50)), float(rng.randrange(0, 50)), float(rng.randrange(98, 101))) for _ in range(25)]
    df = spark.createDataFrame([("A", i, *r, r[2] + 1) for i, r in enumerate(rows)], "instrument string, ts long, bid5 double, ask5 double, best_bid double, best_ask double")
    got = activity.book_pressure(df, 6).orderBy("ts").collect()
    assert got[0].bss is None
    for i in range(1, 25):
        assert (got[i].bss, got[i].ats) == pytest.approx(plain_pressure(rows[max(0, i - 5) : i + 1]))
        assert got[i].light in ("GREEN_GREEN", "GREEN_YELLOW", "YELLOW_RED", "RED_RED")


def rank(v, every):
    return 0.5 if len(every) < 2 else (sum(x < v for x in every) + 0.5 * sum(x == v for x in every)) / len(every)


def test_hot_score(spark):
    rng = random.Random(4)
    rows = [(f"S{i}", "d", rng.gauss(0, 3), rng.random() * 9, rng.random() * 100, rng.gauss(0, 80), rng.gauss(0, 2), rng.gauss(0, 2), rng.random() * 100, None if i % 5 == 0 else rng.random() * 100, i % 7 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "s string, g string, chg double, value double, pressure double, cvd double, p_slope double, c_slope double, bss double, ats double, divergent boolean")
    got = {r.s: r for r in activity.hot_score(df, ["g"]).collect()}
    cols = list(zip(*rows))
    mean = sum(map(abs, cols[2])) / 40
    limit = mean + 2 * (sum((abs(x) - mean) ** 2 for x in cols[2]) / 40) ** 0.5
    for s, _, chg, value, press, cvd, ps, cs, bss, ats, div in rows:
        p, b, o = rank(press, cols[4]), bss / 100, 0.5 if ats is None else ats / 100
        d = div or (abs(chg) > 1.5 and abs(cvd) > 50 and chg * cvd < 0)
        raw = 0.1 * (rank(chg, cols[2]) + rank(value, cols[3]) + clip((ps + 2) / 4, 0, 1) + clip((cs + 2) / 4, 0, 1) + b + o) + 0.2 * (p + rank(cvd, cols[5])) - 0.25 * d - 0.1 * (abs(chg) > limit)
        score = int(100 * clip(raw, 0, 1) + 0.5)
        if score > 70 and not (p > 0.6 and (b > 0.6 or o > 0.6) and not d):
            score = min(score, 69)
        assert got[s].hot == score and 2 <= len(got[s].reasons) <= 6


@pytest.mark.parametrize("net,want", [([0, 1, 2, 0, 0], 2), ([1, 2, 0, -1, -1], -2), ([0, 0, 0, 0, 0], 0), ([1, 1, -1, 1, 0], 1)])
def test_calendar_streak(spark, net, want):
    days = [dt.date(2026, 1, 1 + i) for i in range(5)]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, day_index int")
    df = spark.createDataFrame([("b", d, n) for d, n in zip(days, net)], "broker string, date date, net int")
    assert activity.calendar_streak(df, cal, ["broker"]).first().streak == want


def test_probability_limits(spark):
    rows = [(f"T{i}", "d", float(i), "DISTRIBUTION" if i == 3 else "READY_MARKUP") for i in range(9)]
    df = spark.createDataFrame(rows, "t string, d string, x double, state string")
    got = {r.t: r for r in scoring.probability(df, [(1.0, [(1.0, "x", True)])], ["d"], "x").collect()}
    assert got["T3"].prob == 5 and got["T3"].prob_label == "DISQ"
    assert 5 <= got["T1"].prob < got["T8"].prob <= 90


def one(spark, *raws):
    return spark.createDataFrame([(r,) for r in raws], "raw string")


def test_parsers(spark):
    got = parsers.sector_line(one(spark, "a|b| bbca |rg|x|0|95|100|y|z|7", "too|short", None)).collect()
    assert [(r.symbol, r.board, r.price_high, r.price_low, r.freq_tx) for r in got] == [("BBCA", "RG", 100, 95, 7)]
    got = parsers.level_line(one(spark, "100|5|x|1|2", "0|1|1|1|1")).collect()
    assert [(r.price, r.b_lot, r.s_lot, r.t_lot) for r in got] == [(100, 5, None, 5)]
    got = parsers.done_line(one(spark, "1|bbca|RG|9:01:02|100|5", "1|bbca|NG|9:01:02|100|5", "1|bbca|RG|9h|100|5", "1|bbca|RG|9:01:02|0|5", "1|bbca|RG|9:01:02|100|0")).collect()
    assert [(r.symbol, r.price, r.lot) for r in got] == [("BBCA", 100, 5)]
    got = parsers.daily_stats(one(spark, '{"kode":"A","close":"5","nv":3}', '{"t":"B","c":"x","v":2}')).collect()
    assert [(r.ticker, r.close, r.vol, r.net_vol) for r in got] == [("A", 5, None, 3), ("B", None, 2, None)]


def test_calendar_lines(spark):
    full = "div|cash|7|1771300800|2026|1|2| bbca, bbri |bmri|ok|2|Dividend"
    got = parsers.calendar_line(one(spark, full, "rups|||0|2026|3|9|tlkm||", "x|y|z", "", None, "||3|1771300800")).collect()
    assert [(r.event_type, r.event_subtype, r.seq, str(r.event_date), r.event_time, r.symbol_primary, r.symbols, r.status, r.phase, r.label) for r in got] == [
        ("DIV", "cash", "7", "2026-02-17", "11:00", "BMRI", ["BBCA", "BBRI"], "ok", "2", "Dividend"),
        ("RUPS", None, None, "2026-03-09", None, "TLKM", ["TLKM"], None, None, None),
        ("UNKNOWN", None, "3", "2026-02-17", "11:00", None, [], None, None, None),
    ]


def test_book_payloads(spark):
    init = {"subcmd": "INIT", "BUY": [[100, 7], [99, 10], [98, 1], [97, 1]], "SELL": [[101, 5], [102, 6]]}
    update = "A|B|;|100|101|0|100|7|0|101||5|bad||1|99|3x|2|98|1"
    got = parsers.book_payload(one(spark, json.dumps(init), json.dumps({"raw": json.dumps(init)}), json.dumps({"subcmd": "UPDATE", "recinfo": update}), json.dumps({"recinfo": "odd"}), "no json", None)).collect()
    sides = [([tuple(x) for x in r.bids], [tuple(x) for x in r.offers]) for r in got]
    # the best offer of a snapshot comes last; three levels a side
    assert sides[0] == sides[1] == ([(100, 7), (99, 10), (98, 1)], [(102, 6), (101, 5)])
    assert sides[2] == ([(100, 7), (99, 3)], [(101, 5), (99, 2)])
    assert sides[3:] == [([], [])] * 3
    assert [(r.subcmd, r.best_bid, r.best_offer) for r in got[:4]] == [("INIT", 100, 101), ("INIT", 100, 101), ("UPDATE", 100, 101), ("UNKNOWN", None, None)]


def test_raw_sinks_and_last_days(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2026, 1, 5, 9, 30), 1), ("a", dt.datetime(2026, 1, 5, 10, 0), 2), ("b", dt.datetime(2026, 1, 6, 9, 0), 3)], "symbol string, ts timestamp, x int")
    tables.write_parts(rows, f"{tmp_path}/tape")
    tables.write_parts(rows, f"{tmp_path}/books", ("symbol", "date", "hour"))
    tables.write_parts(rows, f"{tmp_path}/books", ("symbol", "date", "hour"))
    assert sorted((r.hour, r.x) for r in spark.read.parquet(f"{tmp_path}/tape").collect()) == [(9, 1), (9, 3), (10, 2)]
    back = spark.read.parquet(f"{tmp_path}/books")
    assert back.count() == 6 and back.where("symbol = 'b' AND hour = 9").count() == 2
    calendar = spark.createDataFrame([(dt.date(2026, 1, d), k) for k, d in enumerate((2, 5, 6, 7))], "date date, day_index int")
    got = tables.last_days(spark.read.parquet(f"{tmp_path}/tape"), calendar, F.lit("2026-01-06").cast("date"), 2).collect()
    assert sorted((r.x, r.day_offset) for r in got) == [(1, 1), (2, 1), (3, 0)]


def test_candles_are_read_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ticker":"A","t0":60000,"ohlc":{"o":1,"h":2,"l":1,"c":2},"vol":5,"delta":1}\nnot json\n{"ticker":"A","t0":60000,"vol":9,"delta":2}\n{"ticker":"B","t0":60000,"vol":1}\n')
    got = sorted((r.ticker, r.vol) for r in tables.read_candles(spark, f"file://{tmp_path}/a.jsonl").collect())
    assert got == [("A", 9), ("B", 1)]


def test_broker_documents(spark):
    doc = {"data": {"from": "2026-01-19", "broker_summary": {"symbol": "bbca", "brokers_buy": [{"netbs_broker_code": "YP", "bval": "1000", "blot": "10"}], "brokers_sell": [{"netbs_broker_code": "AK", "sval": "-900", "slot": "-9"}]}}}
    empty = {"data": {"from": "2026-01-20", "broker_summary": {"symbol": "bbca", "brokers_buy": [], "brokers_sell": []}}}
    got = parsers.broker_documents(one(spark, json.dumps(doc), json.dumps(empty), "no json")).collect()
    assert sorted((r.broker, r.side, int(r.value), r.lots) for r in got) == [("AK", "sell", 900, 9), ("YP", "buy", 1000, 10)]


def test_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upserted(a, b, ["k"])) == [(1, "a"), (2, "b"), (3, "b")]
    assert rows(tables.upserted(a, b, ["k"], backfill=True)) == [(1, "a"), (2, "a"), (3, "b")]
    assert rows(tables.master_diff(a, b, "k", ["v"])) == [(1, "absent"), (2, "update"), (3, "insert")]
    day = lambda v, *ds: spark.createDataFrame([(d, v) for d in ds], "date string, v int")
    path = str(tmp_path / "t")
    tables.write_days(day(1, "2026-01-01", "2026-01-02"), path)
    tables.write_days(day(2, "2026-01-02"), path)
    assert sorted((str(r.date), r.v) for r in spark.read.parquet(path).collect()) == [("2026-01-01", 1), ("2026-01-02", 2)]
    full, thin = spark.createDataFrame([("FULL",)] * 5, "source string"), spark.createDataFrame([("ZSCORE",)] * 6, "source string")
    assert {r.source for r in tables.guarded(thin, full).collect()} == {"FULL"}
    assert {r.source for r in tables.guarded(thin.union(thin), full).collect()} == {"ZSCORE"}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.jsonl").write_text('{"ticker":"A","t0":1000,"vol":1}\nbroken\n')
    assert [r.vol for r in tables.read_candles(spark, str(tmp_path / "c")).collect()] == [1]


def test_endpoints_run(spark):
    from tapeloom.plans import queries as q
    from tapeloom.sources import adapters

    d = "/root/testdata/sf0.001"
    bars, flow, trades = q.bars(spark, d), q.flow(spark, d), adapters.broker_trades(spark, d)
    context = q.days(spark, d).select("instrument", "date", F.lit("ACCUMULATION").alias("ctx_state"), F.lit(1.0).alias("ctx_z"))
    start, end = F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")
    assert endpoints.footprint_summary(bars, context).count() == q.days(spark, d).count()
    assert endpoints.footprint_range(bars, context, start, end).count() == 5
    assert endpoints.symbol(bars, q.tape.levels(q.signed(spark, d)), "view", "day").count() > 5
    assert endpoints.screener(flow).count() == flow.select("ticker").distinct().count()
    assert endpoints.screener_accumulation(flow).count() >= 0
    assert endpoints.foreign_flow(flow).count() > 0
    assert endpoints.broker_range(trades, F.lit("1995-01-01").cast("date"), F.lit("2001-01-01").cast("date")).count() > 0
    assert endpoints.broker_activity(trades, 1).count() > 0
    e = q.adapters.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("moment"), F.col("event_type").alias("title"))
    assert endpoints.event_feed({"a": e, "b": e}, 7).count() == 7
