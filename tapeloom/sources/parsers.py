"""Raw lines and documents to rows. Nothing is inferred: numbers arrive as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(raw: Column, sep: str = r"\|") -> Column:
    return F.transform(F.split(F.coalesce(raw, F.lit("")), sep), lambda x: F.trim(x))


def _num(c: Column) -> Column:
    return c.try_cast("double")


def _pos(c: Column) -> Column:
    return F.when(_num(c) > 0, _num(c))


def sector_line(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Symbol, board, high, low, last and frequency of lines with 11 fields or more; others are dropped."""
    f = fields(F.col(raw))
    at = lambda i: F.get("_f", i)
    d = df.withColumn("_f", f).where(F.size("_f") >= 11)
    low, last = _pos(at(6)), _pos(at(7))
    high = F.coalesce(_pos(at(5)), F.greatest(F.coalesce(last, F.lit(0.0)), F.coalesce(low, F.lit(0.0))))
    return d.select(*df.columns, F.upper(at(2)).alias("symbol"), F.upper(at(3)).alias("board"), high.alias("price_high"), low.alias("price_low"), last.alias("price_last"), _pos(at(10)).alias("freq_tx"))


def level_line(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Price, bought and sold lots, frequencies and total lots; lines without a price are dropped."""
    at = lambda i: _pos(F.get("_f", i))
    d = df.withColumn("_f", fields(F.col(raw))).where(F.size("_f") >= 5).where(at(0).isNotNull())
    lots = F.coalesce(at(1), F.lit(0.0)) + F.coalesce(at(2), F.lit(0.0))
    return d.select(*df.columns, at(0).alias("price"), at(1).alias("b_lot"), at(2).alias("s_lot"), at(3).alias("b_freq"), at(4).alias("s_freq"), lots.alias("t_lot")).drop("_f")


def done_line(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Done trades of the regular board with price and lots above 0 and a time of day."""
    at = lambda i: F.get("_f", i)
    lot = F.regexp_extract(at(5), r"^(-?\d+)", 1).try_cast("bigint")
    d = df.withColumn("_f", fields(F.col(raw))).where(F.size("_f") >= 6)
    d = d.where((at(1) != "") & (F.upper(at(2)) == "RG") & at(3).rlike(r"^\d{1,2}:\d{2}:\d{2}$") & (_num(at(4)) > 0) & (lot > 0))
    return d.select(*df.columns, at(0).alias("trade_id"), F.upper(at(1)).alias("symbol"), at(3).alias("time"), _num(at(4)).alias("price"), lot.alias("lot"))


def book_payload(df: DataFrame, raw: str = "raw", depth: int = 3) -> DataFrame:
    """subcmd, bids and offers (price, volume) and the best prices of order-book payloads, ``depth`` levels a side.

    A first snapshot (INIT) has arrays BUY and SELL of (price, lots), perhaps
    as JSON inside ``raw``; offers come out with the best one last. An update
    has a string ``recinfo``: after ``|;|`` follow the best bid, the best offer
    and one more field, then triplets of price, bid and offer volume. Any
    other payload gives empty sides.
    """
    shape = "subcmd string, BUY array<array<double>>, SELL array<array<double>>, recinfo string, raw string"
    outer = F.from_json(F.col(raw), shape)
    inner = F.from_json(outer["raw"], shape)
    d = df.withColumn("_p", F.when(outer["subcmd"].isNull() & inner.isNotNull(), inner).otherwise(outer))
    init = F.coalesce((F.col("_p.subcmd") == "INIT") & F.col("_p.BUY").isNotNull() & F.col("_p.SELL").isNotNull(), F.lit(False))
    pair = lambda x: F.struct(x[0].alias("price"), x[1].alias("volume"))
    first = lambda side: F.transform(F.slice(F.col(f"_p.{side}"), 1, depth), pair)
    update = ~init & F.coalesce(F.col("_p.recinfo").contains("|;|"), F.lit(False))
    parts = F.split(F.get(F.split("_p.recinfo", r"\|;\|"), 1), r"\|")
    d = d.withColumn("_f", F.when(update, parts))
    count = F.greatest(F.floor((F.size("_f") - 3) / 3), F.lit(0)).cast("int")
    whole = lambda i: F.coalesce(F.regexp_extract(F.get("_f", i), r"^\s*(-?\d+)", 1).try_cast("double"), F.lit(0.0))
    level = lambda k: F.struct(_num(F.get("_f", 3 * k)).alias("price"), whole(3 * k + 1).alias("bid"), whole(3 * k + 2).alias("offer"))
    levels = F.filter(F.transform(F.sequence(F.lit(1), count), level), lambda x: x["price"].isNotNull())
    d = d.withColumn("_l", F.when(update & (count > 0), levels))
    none = F.array().cast("array<struct<price:double,volume:double>>")
    side = lambda s: F.slice(F.transform(F.filter("_l", lambda x: x[s] > 0), lambda x: F.struct(x["price"].alias("price"), x[s].alias("volume"))), 1, depth)
    best = lambda k, s: F.when(init, F.get(F.col(f"_p.{s}"), 0)[0]).otherwise(_num(F.get("_f", k)))
    return d.select(
        *df.columns,
        F.coalesce("_p.subcmd", F.lit("UNKNOWN")).alias("subcmd"),
        best(0, "BUY").alias("best_bid"),
        best(1, "SELL").alias("best_offer"),
        F.coalesce(F.when(init, first("BUY")).otherwise(side("bid")), none).alias("bids"),
        F.coalesce(F.when(init, F.reverse(first("SELL"))).otherwise(side("offer")), none).alias("offers"),
    )


def calendar_line(df: DataFrame, raw: str = "raw", hours: int = 7) -> DataFrame:
    """Corporate actions: 12 fields, missing ones empty, the clock ``hours`` ahead of UTC.

    Type, subtype, sequence, epoch second, year, month, day, symbols by comma,
    primary symbol, status, phase and label. The date is that of the epoch,
    else of year, month and day; lines without either are dropped.
    """
    f = F.concat(fields(F.col(raw)), F.array_repeat(F.lit(""), 12))
    d = df.where(F.trim(F.col(raw)) != "").withColumn("_f", F.slice(f, 1, 12))
    at = lambda i: F.nullif(F.get("_f", i), F.lit(""))
    epoch = F.when(at(3).try_cast("bigint") > 0, at(3).try_cast("bigint"))
    local = F.timestamp_seconds(epoch + hours * 3600)
    day = F.concat_ws("-", F.lpad(at(4), 4, "0"), F.lpad(at(5), 2, "0"), F.lpad(at(6), 2, "0")).try_cast("date")
    symbols = F.filter(F.transform(F.split(F.get("_f", 7), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    d = d.withColumns({"_local": local, "_symbols": symbols, "_date": F.coalesce(F.to_date(local), day)}).where("_date IS NOT NULL")
    return d.select(
        *df.columns,
        F.coalesce(F.upper(at(0)), F.lit("UNKNOWN")).alias("event_type"),
        at(1).alias("event_subtype"),
        at(2).alias("seq"),
        epoch.alias("epoch"),
        F.col("_date").alias("event_date"),
        F.date_format("_local", "HH:mm").alias("event_time"),
        F.upper(F.coalesce(at(8), F.get("_symbols", 0))).alias("symbol_primary"),
        F.col("_symbols").alias("symbols"),
        at(9).alias("status"),
        at(10).alias("phase"),
        at(11).alias("label"),
    )


#: Aliases of one daily statistic, first match wins.
ALIASES = {"ticker": ("kode", "t"), "close": ("close", "c"), "vol": ("vol", "v"), "net_vol": ("net_vol", "nv"), "freq": ("freq", "f")}


def daily_stats(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows of JSON objects whose fields go by several names; null where no alias is a number."""
    schema = ", ".join(f"{a} string" for names in ALIASES.values() for a in names)
    d = df.withColumn("_o", F.from_json(raw, schema))
    one = lambda names: F.coalesce(*[F.col(f"_o.{a}") for a in names])
    return d.select(*df.columns, *[(one(v) if k == "ticker" else _num(one(v))).alias(k) for k, v in ALIASES.items()])


SIDE = "array<struct<netbs_broker_code:string,{0}:string,{1}:string,{2}:string,type:string>>"
DOCUMENT = (
    "data struct<from:string,broker_summary:struct<symbol:string,"
    f"brokers_buy:{SIDE.format('bval', 'blot', 'bvalv')},brokers_sell:{SIDE.format('sval', 'slot', 'svalv')}>>"
)


def broker_documents(df: DataFrame, raw: str = "raw") -> DataFrame:
    """(date, ticker, broker, side, value, lots) of broker documents; both sides, absolute values.

    Reads the stored shape (brokers_buy, brokers_sell). A document without
    brokers gives no rows.
    """
    d = df.select(F.from_json(raw, DOCUMENT).alias("d")).select(F.to_date("d.data.from").alias("date"), F.upper("d.data.broker_summary.symbol").alias("ticker"), F.col("d.data.broker_summary").alias("s"))
    out = None
    for side, column, value, lots in (("buy", "brokers_buy", "bval", "blot"), ("sell", "brokers_sell", "sval", "slot")):
        rows = d.select("date", "ticker", F.explode(f"s.{column}").alias("b")).select(
            "date", "ticker", F.col("b.netbs_broker_code").alias("broker"), F.lit(side).alias("side"), F.abs(_num(F.col(f"b.{value}"))).cast("decimal(38,0)").alias("value"), F.abs(_num(F.col(f"b.{lots}"))).cast("bigint").alias("lots")
        )
        out = rows if out is None else out.unionByName(rows)
    return out
