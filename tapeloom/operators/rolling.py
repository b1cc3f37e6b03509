"""Rolling features of daily rows: z-scores, relative volume, averages, RSI, percentiles, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio, zscore

Z_WINDOWS = (5, 10, 20)


def smart_money(flow: DataFrame) -> DataFrame:
    """Effort, net, return, result, net-to-gross ratio and elasticity of every ticker-day."""
    w = W.partitionBy("ticker").orderBy("date")
    d = flow.withColumn("effort", F.col("total_value").cast("double")).withColumn("net", F.col("foreign_net").cast("double"))
    before = F.lag("price").over(w)
    d = d.withColumn("ret", F.coalesce(ratio(F.col("price") - before, F.when(before > 0, before)), F.lit(0.0)))
    d = d.withColumn("result", F.abs("ret")).withColumn("ngr", F.coalesce(ratio(F.abs("net"), F.col("effort")), F.lit(0.0)))
    return d.withColumn("elas", F.col("result") / (F.abs("net") + 1e-9))


def rolling_z(d: DataFrame, columns: tuple, windows: tuple = Z_WINDOWS, key: str = "ticker", date: str = "date") -> DataFrame:
    """z of the current row in the last n rows, itself included; one sort serves all."""
    out = d
    for n in windows:
        w = W.partitionBy(key).orderBy(date).rowsBetween(-(n - 1), 0)
        for c in columns:
            x = F.col(c)
            out = out.withColumn(f"z_{c}_{n}", zscore(x, F.avg(x).over(w), F.stddev_pop(x).over(w), F.count(x).over(w)))
    return out


def vwap_z(d: DataFrame, n: int, price: str = "close", volume: str = "vol", key: str = "instrument") -> DataFrame:
    """z of the price's deviation from the window's VWAP; the deviation is linear in price, so VWAP drops out."""
    w = W.partitionBy(key).orderBy("date").rowsBetween(-(n - 1), 0)
    p = F.col(price)
    z = zscore(p, F.avg(p).over(w), F.stddev_pop(p).over(w), F.count(p).over(w))
    has = F.sum(p * F.col(volume)).over(w) > 0
    return d.withColumn(f"z_vwap_{n}", F.when(has & (p > 0), z).otherwise(0.0))


def regime(d: DataFrame) -> DataFrame:
    """State and score from yesterday's effort and today's result; ``d`` has smart_money and 20-row z columns."""
    w = W.partitionBy("ticker").orderBy("date")
    e1, e2 = F.lag("z_effort_20", 1).over(w), F.lag("z_effort_20", 2).over(w)
    rows20 = w.rowsBetween(-19, 0)
    d = d.withColumn("effort_z", F.coalesce(e1, F.col("z_effort_20"))).withColumn("_e2", e2).withColumn("_n", F.row_number().over(w))
    d = d.withColumn("_elas_mean", F.avg("elas").over(rows20))
    declining = (F.col("effort_z") < -0.3) & (F.col("_n") > 1) & F.coalesce(F.col("_e2") > 0.3, F.lit(True))
    r, ret = F.col("z_result_20"), F.col("ret")
    high = F.col("effort_z") > 0.5
    state = (
        F.when(declining & (r > -0.5) & (F.col("elas") > F.col("_elas_mean") * 1.1), "READY_MARKUP")
        .when(high & (F.abs(r) < 0.5), "TRANSITION")
        .when(high & (r < -0.5) & (ret >= 0), "ACCUMULATION")
        .when(high & (ret < -0.01), "DISTRIBUTION")
        .otherwise("NEUTRAL")
    )
    score = F.col("effort_z") - F.abs(r) + (1 - F.col("z_elas_20")) + 0.5 * F.col("z_ngr_20")
    return d.withColumn("state", state).withColumn("score", score).drop("_e2", "_n", "_elas_mean")


def relative_volume(d: DataFrame, n: int, variant: str = "rows", key: str = "instrument", volume: str = "vol") -> DataFrame:
    """Volume over the average of earlier ones.

    rows: the last n rows with volume, all needed. positions: the last n rows,
    those without volume skipped in the average but counted. calendar: the
    days 1..n before, the average of those with volume.
    """
    v = F.when(F.col(volume) > 0, F.col(volume))
    if variant == "calendar":
        w = W.partitionBy(key).orderBy(F.datediff("date", F.lit("1970-01-01"))).rangeBetween(-n, -1)
        return d.withColumn(f"rvol_{n}", ratio(F.col(volume), F.avg(v).over(w)))
    source = d.where(F.col(volume) > 0) if variant == "rows" else d
    w = W.partitionBy(key).orderBy("date").rowsBetween(-n, -1)
    return source.withColumn(f"rvol_{n}", F.when(F.count(F.lit(1)).over(w) >= n, ratio(F.col(volume), F.avg(v).over(w))))


def moving_averages(d: DataFrame, windows: tuple = (5, 10, 20), key: str = "instrument", price: str = "close") -> DataFrame:
    """Averages of the last n rows, null until there are n."""
    for n in windows:
        w = W.partitionBy(key).orderBy("date").rowsBetween(-(n - 1), 0)
        d = d.withColumn(f"ma_{n}", F.when(F.count(price).over(w) == n, F.avg(price).over(w)))
    return d


def rsi(d: DataFrame, period: int = 14, max_rows: int = 35, key: str = "instrument", price: str = "close") -> DataFrame:
    """Wilder's RSI of the newest row from the last ``max_rows`` closes, per key; null with too few."""
    newest = W.partitionBy(key).orderBy(F.desc("date"))
    last = d.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= max_rows)
    closes = F.transform(F.array_sort(F.collect_list(F.struct("date", F.col(price).alias("c")))), lambda x: x["c"])
    g = last.groupBy(key).agg(closes.alias("c"), F.max("date").alias("date"))
    diffs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i) - F.get("c", i - 1))
    g = g.withColumn("d", F.when(F.size("c") > 1, diffs).otherwise(F.array().cast("array<double>")))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("g"), F.lit(0.0).alias("l"))

    def step(a, x):
        up, down = F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))
        warm = a["i"] < period
        move = lambda old, new: F.when(warm, old + new / period).otherwise((old * (period - 1) + new) / period)
        return F.struct((a["i"] + 1).alias("i"), move(a["g"], up).alias("g"), move(a["l"], down).alias("l"))

    g = g.withColumn("s", F.aggregate("d", zero, step))
    value = F.when(F.col("s.l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("s.g"), F.col("s.l"))))
    return g.select(key, "date", F.when(F.col("s.i") >= period, value).alias("rsi"))


def _peers(x: Column, by: list[str]) -> tuple[Column, Column, Column]:
    """(rows with a value, rows below, rows equal) by one sort: the share of rows up to the last equal one gives the equal ones."""
    w = W.partitionBy(*by)
    ordered = w.orderBy(x.asc_nulls_last())
    below = F.rank().over(ordered) - 1
    upto = F.round(F.cume_dist().over(ordered) * F.count(F.lit(1)).over(w)).cast("long")
    return F.count(x).over(w), below, upto - below


def mid_rank(x: Column, by: list[str]) -> Column:
    """(values below + half of the equal ones) / n, among the rows of ``by``; 0.5 alone."""
    n, below, equal = _peers(x, by)
    return F.when(x.isNotNull(), F.when(n <= 1, 0.5).otherwise((below + 0.5 * equal) / n))


def average_rank(x: Column, by: list[str], fallback: float = 0.5) -> Column:
    """Average rank / (n - 1) among the rows of ``by`` that have a value; others get ``fallback``."""
    n, below, equal = _peers(x, by)
    p = (below + (equal - 1) / 2) / F.nullif(n - 1, F.lit(0))
    return F.when(x.isNull(), fallback).when(n <= 1, 0.5).otherwise(p)


def lookback_sums(d: DataFrame, calendar: DataFrame, windows: tuple = (2, 5, 10, 20), key: str = "instrument") -> DataFrame:
    """Sum of delta and its share of volume over the last n trading days (of ``calendar``: date, day_index)."""
    d = d.join(calendar, "date")  # one row a trading day
    for n in windows:
        w = W.partitionBy(key).orderBy("day_index").rangeBetween(-(n - 1), 0)
        d = d.withColumn(f"cvd_{n}", F.sum("delta").over(w)).withColumn(f"cvd_pct_{n}", ratio(100 * F.sum("delta").over(w), F.sum("vol").over(w)))
    return d


def trading_calendar(dates: DataFrame, holidays: tuple = ()) -> DataFrame:
    """(date, day_index, previous): the weekdays of ``dates`` without holidays, numbered from 0."""
    open_ = ~F.dayofweek("date").isin(1, 7)
    if holidays:
        open_ = open_ & ~F.col("date").cast("string").isin(*holidays)
    days = dates.select("date").distinct().where(open_)
    w = W.orderBy("date")  # a calendar: a few hundred rows a year
    return days.withColumn("day_index", F.row_number().over(w) - 1).withColumn("previous", F.lag("date").over(w))


def carried_averages(points: DataFrame, unit: str = "hour", value: str = "price") -> DataFrame:
    """Average by bucket on a gapless grid; empty buckets keep the last average."""
    w = W.partitionBy("instrument").orderBy("bucket")
    return average_grid(points, unit, value).withColumn("avg", F.last("avg", ignorenulls=True).over(w))


def average_grid(points: DataFrame, unit: str = "hour", value: str = "price") -> DataFrame:
    """Average by bucket on a gapless grid; null in empty buckets."""
    b = points.groupBy("instrument", F.date_trunc(unit, "ts").alias("bucket")).agg(F.avg(F.col(value).cast("decimal(18,2)")).cast("double").alias("avg"))
    ends = b.groupBy("instrument").agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"))
    grid = ends.select("instrument", F.explode(F.sequence("a", "z", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return grid.join(b, ["instrument", "bucket"], "left")
