"""Trades from files to candles as a stream: de-duplication, watermark, one candle per closed minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One line of the tape: a pipe-delimited trade, or an object with aliased fields.
ENVELOPE = (
    "v int, fmt string, src string, raw string, ts bigint, ts_quality string, trade struct<kode:string,code:string,symbol:string,ticker:string,"
    "papan:string,board:string,harga:double,price:double,last:double,vol:double,qty:double,volume:double,amount:double,time:string>"
)


def _number(c: Column) -> Column:
    return c.try_cast("double")


def normalised(lines: DataFrame) -> DataFrame:
    """(ts, instrument, board, price, qty, src, hash_id, reject) of envelopes, whatever their format.

    ``raw`` is ``YYYYMMDD|HHMMSS|x|CODE|BOARD|TYPE|PRICE|VOL`` in local time
    (UTC+7); if field 0 is no date the envelope's ``ts`` is the event time.
    ``reject`` names the first rule that a trade breaks; nothing is dropped.
    """
    f = F.split(F.coalesce("raw", F.lit("")), r"\|")
    at = lambda i: F.get(f, F.lit(i))
    dated = at(0).rlike("^[0-9]{8}$") & at(1).rlike("^[0-9]{6}$")
    local = F.to_timestamp(F.concat(at(0), at(1)), "yyyyMMddHHmmss")
    own = F.timestamp_millis("ts")
    piped = F.size(f) >= 8
    pick = lambda pos, *names: F.when(piped, at(pos)).otherwise(F.coalesce(*[F.col(f"trade.{n}").cast("string") for n in names]))
    out = lines.select(
        F.when(piped & dated, local - F.expr("INTERVAL 7 HOURS")).otherwise(own).alias("ts"),
        F.upper(F.trim(pick(3, "kode", "code", "symbol", "ticker"))).alias("instrument"),
        F.upper(F.trim(pick(4, "papan", "board"))).alias("board"),
        _number(pick(6, "price", "last", "harga")).alias("price"),
        _number(pick(7, "volume", "vol", "qty", "amount")).alias("qty"),
        F.coalesce("src", F.lit("")).alias("src"),
        F.sha2(F.concat_ws("|", "src", F.when(piped, F.concat(F.lit("pipe|"), "raw")).otherwise(F.concat(F.lit("obj|"), F.to_json("trade"), F.col("ts").cast("string")))), 256).alias("hash_id"),
    )
    bad = F.when(F.col("ts").isNull(), "time").when(F.coalesce("instrument", F.lit("")) == "", "instrument").when(F.coalesce("board", F.lit("")) != "RG", "board")
    price, qty = F.col("price"), F.col("qty")
    bad = bad.when(price.isNull() | F.isnan(price) | (price <= 0), "price").when(qty.isNull() | F.isnan(qty) | (qty <= 0), "quantity")
    return out.withColumn("reject", bad)


def accepted(trades: DataFrame) -> DataFrame:
    return trades.where("reject IS NULL").drop("reject")


def _fold(ticks: Column) -> Column:
    """Candle of ordered (ts, hash_id, price, qty): tick rule within the bucket, the first trade neutral."""
    start = F.struct(
        F.lit(None).cast("double").alias("o"), F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("l"), F.lit(None).cast("double").alias("c"), F.lit(0.0).alias("vol"), F.lit(0.0).alias("delta")
    )

    def step(a, x):
        sign = F.coalesce(F.signum(x["price"] - a["c"]), F.lit(0.0))
        return F.struct(
            F.coalesce(a["o"], x["price"]).alias("o"),
            F.greatest(a["h"], x["price"]).alias("h"),
            F.least(a["l"], x["price"]).alias("l"),
            x["price"].alias("c"),
            (a["vol"] + x["qty"]).alias("vol"),
            (a["delta"] + sign * x["qty"]).alias("delta"),
        )

    return F.aggregate(ticks, start, step)


def minute_candles(trades: DataFrame, delay: str = "5 minutes", width: str = "1 minute") -> DataFrame:
    """Candles of accepted trades, the same plan for batches and streams.

    Duplicates within the watermark are dropped by ``hash_id``; later trades
    are dropped, never replace a finished candle. A bucket's trades of one
    instrument are one fold, ordered by (ts, hash_id).
    """
    t = trades.withWatermark("ts", delay)
    t = t.dropDuplicatesWithinWatermark(["hash_id"]) if trades.isStreaming else t.dropDuplicates(["hash_id"])
    g = t.groupBy(F.window("ts", width).alias("w"), "instrument").agg(F.sort_array(F.collect_list(F.struct("ts", "hash_id", "price", "qty"))).alias("t"))
    return g.select("instrument", F.col("w.start").alias("bucket"), _fold(F.col("t")).alias("k"), F.size("t").alias("trades")).select("instrument", "bucket", "k.*", "trades")


def read_tape(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the NDJSON files of a folder; malformed lines give empty envelopes that are rejected."""
    return spark.readStream.schema(ENVELOPE).json(folder)


def write_candles(candles: DataFrame, folder: str, checkpoint: str):
    """Append finished candles by date; returns the running query, which ends when the input is used up."""
    dated = candles.withColumn("date", F.to_date("bucket"))
    return dated.writeStream.format("parquet").partitionBy("date").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
