"""Screens, repairs and digests: filters over feature rows and rules on data quality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import clamp, positive, ratio, unit
from tapeloom.operators import relational
from tapeloom.operators.scoring import first_match

TREND_BANDS = {"up2": (3, None), "up1": (1, 2), "neutral": (0, 0), "down1": (-2, -1), "down2": (None, -3)}


def between(x: Column, low, high) -> Column:
    """Within low..high, ends included; an end that is None is open."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return ok


def activity_filter(rows: DataFrame, *, brokers=None, search: str = "", side: str = "any", breadth: int = 0, total: float = 0, trend: str = "any", quadrants: DataFrame | None = None, quadrant: str = "any") -> DataFrame:
    """Broker-stock rows (broker, ticker, net, total, trend) that pass every given test; breadth and quadrant are the broker's."""
    out = rows
    if breadth:
        # distinct stocks by broker: a join with a reduced table, as a window cannot count distinct values
        wide = rows.groupBy("broker").agg(F.count_distinct("ticker").alias("_b")).where(F.col("_b") >= breadth).select("broker")
        out = out.join(wide, "broker", "left_semi")
    if quadrant != "any" and quadrants is not None:
        out = out.join(quadrants.where(F.col("quadrant") == quadrant).select("broker"), "broker", "left_semi")
    if brokers:
        out = out.where(F.col("broker").isin(*brokers))
    if search:
        s = search.upper().strip()
        out = out.where(F.upper(F.col("broker").cast("string")).contains(s) | F.upper("ticker").contains(s))
    if side != "any":
        out = out.where(F.col("net") > 0 if side == "buy" else F.col("net") < 0)
    if total:
        out = out.where(F.col("total") >= total)
    if trend != "any":
        out = out.where(between(F.col("trend"), *TREND_BANDS[trend]))
    return out


def detail_filter(rows: DataFrame, *, net=(None, None), buy=(None, None), sell=(None, None), only: str = "any", streak: int = 0, momentum: float = 0, days: int = 0) -> DataFrame:
    """One broker's stocks within ranges; ``only`` is buy, sell or any; a negative streak or momentum asks for distribution."""
    out = rows.where(between(F.col("net"), *net) & between(F.col("buy"), *buy) & between(F.col("sell"), *sell))
    if only != "any":
        out = out.where((F.col("buy") > 0) & (F.col("sell") <= 0) if only == "buy" else (F.col("sell") > 0) & (F.col("buy") <= 0))
    for name, least in (("streak", streak), ("momentum", momentum)):
        if least:
            out = out.where(F.col(name) >= least if least > 0 else F.col(name) <= least)
    return out.where(F.col("days") >= days) if days else out


def is_ticker(x: Column) -> Column:
    """Two to four capital letters or digits."""
    return F.coalesce(x.rlike("^[A-Z0-9]{2,4}$"), F.lit(False))


def symbol_list(text: str, most: int = 120) -> list[str]:
    """Symbols of a list by comma, in capitals: two to six letters each, without repeats, at most ``most``."""
    parts = (x.strip().upper() for x in text.split(","))
    return list(dict.fromkeys(x for x in parts if re.fullmatch("[A-Z]{2,6}", x)))[:most]


def up_to_hour(bucket: str, hour: int) -> Column:
    """Before the end of the hour; hour 23 is no limit."""
    return F.lit(True) if hour >= 23 else F.hour(bucket) <= hour


def growth_by_precedence(d: DataFrame, sources: list[str], close: str = "close") -> DataFrame:
    """The previous close from the first source that has one above 0, and the growth to ``close`` in per cent."""
    previous = F.coalesce(*[positive(F.col(c)) for c in sources])
    return d.withColumn("previous", previous).withColumn("growth", ratio((F.col(close) - F.col("previous")) * 100, F.col("previous")))


def at_least(column: str, threshold: float) -> Column:
    """A missing value counts as minus infinity."""
    return F.coalesce(F.col(column).cast("double"), F.lit(float("-inf"))) >= threshold


def repair_plan(d: DataFrame, today: Column) -> DataFrame:
    """repair, priority and missing_ratio from candles, completeness, missing (hours of 8) and thin."""
    none = F.coalesce(F.col("candles"), F.lit(0)) == 0
    sparse = F.col("completeness") == "SPARSE_DATA"
    cut = ~F.col("completeness").isin("COMPLETE", "SPARSE_DATA", "NO_DATA")
    hours = (F.col("date") != today) & ~sparse & (F.col("missing") >= 2)
    d = d.withColumn("repair", none | F.coalesce("thin", F.lit(False)) | cut | hours)
    return d.withColumn("priority", F.when(cut & ~none, "high").otherwise("normal")).withColumn("missing_ratio", F.col("missing") / 8)


def resolved_ohlc(ohlc: Column, open_: Column, close: Column, price: Column) -> Column:
    """Struct o, h, l, c without nulls: inner values first, then the flat ones, then what can be derived."""
    base = F.coalesce(open_, close, price, F.lit(0.0))
    o, c = F.coalesce(ohlc["o"], base), F.coalesce(ohlc["c"], close, base)
    return F.struct(o.alias("o"), F.coalesce(ohlc["h"], F.greatest(o, c)).alias("h"), F.coalesce(ohlc["l"], F.least(o, c)).alias("l"), c.alias("c"))


def compact_map(z: Column, digits: int = 2) -> Column:
    """Window -> rounded value; window 2 falls back to 5."""
    z = F.transform_values(z, lambda _, v: F.round(v, digits))
    return F.when(F.element_at(z, "2").isNull() & F.element_at(z, "5").isNotNull(), F.map_concat(F.map_filter(z, lambda k, _: k != "2"), F.create_map(F.lit("2"), F.element_at(z, "5")))).otherwise(z)


def context_only(d: DataFrame) -> DataFrame:
    """Score and signal of rows that have a context (ctx_state, ctx_z) but no trades of the day: at most 0.6."""
    z, acc, dis = F.coalesce("ctx_z", F.lit(0.0)), F.col("ctx_state") == "ACCUMULATION", F.col("ctx_state") == "DISTRIBUTION"
    signal = first_match([(acc & (z > 1.0), "WATCH_ACCUM"), (acc, "WATCH"), (dis & (z < -1.0), "STRONG_SELL"), (dis, "SELL")], "NO_INTRADAY")
    return d.withColumn("score", clamp(unit(z, -3, 3) * 0.6, 0.0, 1.0)).withColumn("signal", signal)


def health(d: DataFrame, limit: float = 0.10) -> DataFrame:
    """Counts by severity and what to do: nothing, repair the critical rows or rebuild all."""
    h = d.agg(F.count("*").alias("checked"), F.count_if(F.col("severity") == "WARNING").alias("warning"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    rate = F.coalesce(ratio(F.col("critical"), F.col("checked")), F.lit(0.0))
    return h.withColumn("action", F.when(rate > limit, "FULL_REBUILD").when(F.col("critical") > 0, "SELECTIVE_REPAIR").otherwise("NONE"))


def sample_with(rows: DataFrame, key: str, n: int, always: tuple = (), seed: int = 1) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key, and those of the mandatory keys."""
    must = F.col(key).isin(*always) if always else F.lit(False)
    return rows.where(must).unionByName(rows.where(~must).orderBy(F.xxhash64(F.lit(seed), key), key).limit(n))


def snapshot_digest(s: DataFrame, key: str = "symbol") -> DataFrame:
    """First and last snapshot of each key: prices, growth, frequency from the last levels, change of cumulative delta."""
    g = s.groupBy(key).agg(F.min_by(F.struct("price_last", "cvd_lot"), "ts").alias("a"), F.max_by(F.struct("price_last", "price_high", "price_low", "cvd_lot", "freq_tx", "levels"), "ts").alias("z"), F.count("*").alias("snapshots"))
    total = F.aggregate("z.levels", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["b_freq"], F.lit(0.0)) + F.coalesce(x["s_freq"], F.lit(0.0)))
    has = F.coalesce(F.size("z.levels") > 0, F.lit(False))
    growth = F.round(ratio((F.col("z.price_last") - F.col("a.price_last")) * 100, F.col("a.price_last")), 4)
    return g.select(
        key,
        F.when(has, total).otherwise(F.col("z.freq_tx")).alias("freq_tx"),
        F.col("a.price_last").alias("price_open"),
        F.col("z.price_last").alias("price_last"),
        F.col("z.price_high").alias("price_high"),
        F.col("z.price_low").alias("price_low"),
        growth.alias("growth_pct"),
        F.col("z.cvd_lot").alias("cvd_lot"),
        (F.col("z.cvd_lot") - F.col("a.cvd_lot")).alias("cvd_delta"),
        "snapshots",
    )


def target_average(rows: DataFrame, key: str, aliases: list[str]) -> DataFrame:
    """Mean over the key's rows of the first alias field above 0; rows without one are skipped."""
    first = F.coalesce(*[positive(F.col(a).try_cast("double")) for a in aliases])
    return rows.withColumn("_t", first).where("_t IS NOT NULL").groupBy(key).agg(F.avg("_t").alias("target"), F.count("*").alias("n"))


def relative_volume_fallback(d: DataFrame, n: int, key: str = "instrument", volume: str = "vol", index: str = "day_index") -> DataFrame:
    """Volume over the mean of the previous max(n-1, 1) positive ones, among fewer than 3n earlier calendar slots."""
    w = W.partitionBy(key).orderBy(index)
    need = max(n - 1, 1)
    p = d.where(F.col(volume) > 0)
    earlier = F.collect_list(F.struct(F.col(index).alias("i"), F.col(volume).alias("v"))).over(w.rowsBetween(-need, -1))
    p = p.withColumn("_e", F.filter(earlier, lambda x: F.col(index) - x["i"] < 3 * n))
    mean = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x["v"]) / F.nullif(F.size("_e"), F.lit(0))
    return p.withColumn(f"rvol_{n}", ratio(F.col(volume), mean)).drop("_e")


def timeline_candles(rows: DataFrame) -> DataFrame:
    """Flat candles from a day's timeline (ticker, day_stats, timeline of t, p, dv, haka): one price each, delta from the balance."""
    e = rows.select("ticker", F.explode("timeline").alias("x"))
    vol = F.coalesce("x.dv", F.lit(0.0))
    delta = vol * (F.coalesce("x.haka", F.lit(50.0)) / 50 - 1)
    return e.select("ticker", F.col("x.t").alias("t"), *[F.col("x.p").alias(k) for k in ("open", "high", "low", "close")], vol.alias("vol"), delta.alias("delta"))


def skeletal(bars: DataFrame, level_rows: DataFrame, first: int = 10, key: str = "instrument") -> DataFrame:
    """(key, date, broken): a day is broken if one of its first ``first`` candles with volume has no levels."""
    early = relational.top(bars.where("vol > 0"), [key, "date"], [F.asc("bucket")], first)
    have = level_rows.where("bv + av > 0").select(key, "bucket").distinct().withColumn("_has", F.lit(True))
    return early.join(have, [key, "bucket"], "left").groupBy(key, "date").agg(F.bool_or(F.col("_has").isNull()).alias("broken"))


def sector_cvd(snapshots: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Cumulative delta of every symbol, from the first sector that lists it (``place`` orders the sectors): the given one, else that of the levels."""
    first = relational.top(snapshots.where(F.coalesce(F.col(symbol), F.lit("")) != ""), [symbol], [F.asc("place")], 1)
    lots = lambda x, c: F.coalesce(x[c].cast("double"), F.lit(0.0))
    of_levels = F.when(F.size("levels") > 0, F.aggregate("levels", F.lit(0.0), lambda a, x: a + lots(x, "b_lot") - lots(x, "s_lot")))
    return first.select(F.upper(symbol).alias(symbol), "sector", F.coalesce(F.col("cvd_lot").cast("double"), of_levels).alias("cvd_lot"), "freq_tx", "price_last")


def order_flow_snapshots(snapshots: DataFrame, symbols: str, symbol: str = "symbol", most: int = 120) -> DataFrame:
    """The newest snapshot (by ts) of each symbol of a comma-separated list; of the list the first ``most`` valid names count."""
    names = [t for t in dict.fromkeys(x.strip() for x in symbols.upper().split(",")) if re.fullmatch("[A-Z]{2,6}", t)]
    return relational.latest(snapshots.where(F.upper(symbol).isin(names[:most])), [symbol], "ts")
