import json

from pyspark.sql import functions as F

from tapeloom.streaming import candles as c

BASE = 1_767_664_800_000  # 2026-01-06 02:00:00 UTC


def line(seconds, price, qty, code="AADI", board="RG"):
    h, rest = divmod(9 * 3600 + seconds, 3600)
    clock = f"{h:02d}{rest // 60:02d}{rest % 60:02d}"
    return {"v": 1, "fmt": "pipe", "src": "lt", "ts": BASE, "raw": f"20260106|{clock}|0|{code}|{board}|T|{price}|{qty}"}


TRADES = [line(10, 100, 10), line(20, 101, 20), line(50, 99, 30), line(65, 100, 40), line(90, 102, 50), line(115, 101, 60)]
REJECTS = [line(30, 100, 5, board="NG"), line(31, 100, 0), line(32, "x", 5), {"v": 1, "src": "lt", "ts": BASE, "raw": "1|2|3"}]
AS_OBJECT = {"v": 1, "src": "lt", "ts": BASE + 3_000, "trade": {"kode": "bbca", "papan": "RG", "harga": 50.0, "vol": 7.0}}


def rows(df):
    return {(r.instrument, r.bucket.strftime("%H:%M")): (r.o, r.h, r.l, r.c, r.vol, r.delta) for r in df.collect()}


WANT = {("AADI", "02:00"): (100, 101, 99, 99, 60, -10), ("AADI", "02:01"): (100, 102, 100, 101, 150, -10), ("BBCA", "02:00"): (50, 50, 50, 50, 7, 0)}


def test_stream_equals_batch_with_duplicates_and_rejects(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [*TRADES, TRADES[1], *REJECTS, AS_OBJECT]
    (src / "a.ndjson").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    batch = spark.read.schema(c.ENVELOPE).json(str(src))
    n = c.normalised(batch)
    assert n.where("reject IS NOT NULL").count() == len(REJECTS) + 1
    assert rows(c.minute_candles(c.accepted(n))) == WANT
    # a sentinel moves the watermark past the last minute
    (src / "b.ndjson").write_text(json.dumps(line(1800, 100, 1, code="ZZZZ")) + "\n")
    stream = c.read_tape(spark, str(src))
    q = c.write_candles(c.minute_candles(c.accepted(c.normalised(stream))), str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).where(F.col("instrument") != "ZZZZ")) == WANT
