"""Broker transactions to foreign, local and retail flow; accumulation, streaks and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import flow_group, ratio

WINDOWS = (2, 5, 10, 20)


def _net(group: str | None = None) -> Column:
    """Signed value of a trade, of one group or all."""
    v = F.when(F.col("side") == "buy", F.col("value")).otherwise(-F.col("value"))
    return F.sum(F.when(F.col("group") == group, v).otherwise(0) if group else v)


def _gross(side: str, group: str) -> Column:
    return F.sum(F.when((F.col("side") == side) & (F.col("group") == group), F.col("value")).otherwise(0))


def daily_flow(trades: DataFrame, brokers: DataFrame, variant: str = "flow") -> DataFrame:
    """Per date and ticker: buys, sells and net of each group, smart net, average price, broker counts."""
    # sums by broker come first: the dimension joins a reduced table
    per = trades.groupBy("date", "ticker", "broker", "side").agg(F.sum("value").alias("value"), F.sum("lots").alias("lots"))
    per = per.join(brokers, "broker", "left").withColumn("group", flow_group(F.coalesce("category", F.lit("")), F.coalesce("type", F.lit("")), variant))
    columns = [c for g in ("foreign", "local", "retail") for c in (_gross("buy", g).alias(f"{g}_buy"), _gross("sell", g).alias(f"{g}_sell"), _net(g).alias(f"{g}_net"))]
    out = per.groupBy("date", "ticker").agg(
        *columns,
        F.sum("value").alias("total_value"),
        F.sum("lots").alias("total_lots"),
        F.count_if(F.col("side") == "buy").alias("buyers"),
        F.count_if(F.col("side") == "sell").alias("sellers"),
    )
    out = out.withColumn("smart_net", F.col("foreign_net") + F.col("local_net"))
    return out.withColumn("price", F.floor(ratio(F.col("total_value"), F.col("total_lots"))).cast("long"))


def traded_volume(raw: Column, value: Column, average: Column, lots: Column) -> Column:
    """The volume as given; where it is missing or 0 the value over the average price, else the lots."""
    given = F.when(raw > 0, raw.cast("double"))
    return F.coalesce(given, ratio(value, F.when(average > 0, average)), lots.cast("double"))


def broker_net(trades: DataFrame, keys: tuple) -> DataFrame:
    """Buys, sells, net value and net lots by ``keys``."""
    buy = F.col("side") == "buy"
    part = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    out = trades.groupBy(*keys).agg(part("value", buy).alias("buy"), part("value", ~buy).alias("sell"), part("lots", buy).alias("buy_lots"), part("lots", ~buy).alias("sell_lots"))
    return out.withColumn("net", F.col("buy") - F.col("sell")).withColumn("net_lots", F.col("buy_lots") - F.col("sell_lots"))


def accumulation_status(trades: DataFrame, keys: tuple = ("date", "ticker")) -> DataFrame:
    """Top 1, 3 and 5 net buyers against net sellers, and the status that the five give."""
    net = broker_net(trades, (*keys, "broker"))
    w = W.partitionBy(*keys)
    net = net.withColumn("rb", F.row_number().over(w.orderBy(F.desc("net"), "broker"))).withColumn("rs", F.row_number().over(w.orderBy("net", "broker")))
    top = lambda r, n, sign: F.coalesce(F.sum(F.when((F.col(r) <= n) & (sign * F.col("net") > 0), sign * F.col("net"))), F.lit(0))
    out = net.groupBy(*keys).agg(
        *[top("rb", n, 1).alias(f"top{n}_buy") for n in (1, 3, 5)],
        *[top("rs", n, -1).alias(f"top{n}_sell") for n in (1, 3, 5)],
        F.count_if(F.col("net") > 0).alias("buyers"),
        F.count_if(F.col("net") < 0).alias("sellers"),
    )
    b, s = F.col("top5_buy").cast("double"), F.col("top5_sell").cast("double")
    status = F.when(b > s * 1.2, "Big Akum").when(b > s * 1.05, "Akumulasi").when(s > b * 1.2, "Big Dist").when(s > b * 1.05, "Distribusi").otherwise("Neutral")
    return out.withColumn("status", status)


def accumulation_windows(flow: DataFrame, windows: tuple = WINDOWS) -> DataFrame:
    """Per ticker and window of its last rows: sums, streak, flags and price change; rows only for complete windows."""
    newest = W.partitionBy("ticker").orderBy(F.desc("date"))
    f = flow.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= max(windows))
    # 1 as long as every newer row was positive too
    run = newest.rowsBetween(W.unboundedPreceding, 0)
    f = f.withColumn("run", F.min((F.col("smart_net") > 0).cast("int")).over(run))
    f = f.select("*", F.explode(F.array(*map(F.lit, windows))).alias("w")).where(F.col("k") <= F.col("w"))
    out = f.groupBy("ticker", "w").agg(
        F.count("*").alias("days"),
        F.sum("foreign_net").alias("fn"),
        F.sum("local_net").alias("ln"),
        F.sum("retail_net").alias("rn"),
        F.sum("run").alias("streak"),
        F.bool_and(F.col("smart_net") > 0).alias("all_pos"),
        F.bool_and(F.col("foreign_net") > 0).alias("foreign_all_pos"),
        F.bool_and(F.col("local_net") > 0).alias("local_all_pos"),
        F.max_by("price", "k").alias("first_price"),
        F.min_by("price", "k").alias("last_price"),
    )
    out = out.where(F.col("days") == F.col("w")).withColumn("sm", F.col("fn") + F.col("ln"))
    change = F.coalesce(ratio((F.col("last_price") - F.col("first_price")) * 100, F.col("first_price")), F.lit(0.0))
    return out.withColumn("foreign_dominant", F.col("fn") > 0).withColumn("pct_chg", change)


def signed_streak(net: DataFrame, key: tuple, date: str = "date", value: str = "net") -> DataFrame:
    """Length of the newest run of one sign, negative for selling; 0 if the newest is 0."""
    newest = W.partitionBy(*key).orderBy(F.desc(date))
    s = net.withColumn("_s", F.signum(value).cast("int"))
    s = s.withColumn("_first", F.first("_s").over(newest))
    s = s.withColumn("_run", F.min((F.col("_s") == F.col("_first")).cast("int")).over(newest.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*key).agg((F.max("_first") * F.sum("_run")).alias("streak"))


def cumulative_net(net: DataFrame, key: tuple, date: str = "date", value: str = "net") -> DataFrame:
    run = W.partitionBy(*key).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return net.withColumn("cum_net", F.sum(value).over(run))


def flow_trend(flow: DataFrame, least: int = 3) -> DataFrame:
    """Slope of the cumulative foreign net by ticker and a 0..4 score; tickers with fewer rows are left out."""
    run = W.partitionBy("ticker").orderBy("date")
    c = flow.withColumn("i", F.row_number().over(run) - 1).withColumn("cum", F.sum("foreign_net").over(run.rowsBetween(W.unboundedPreceding, 0)))
    out = c.groupBy("ticker").agg(F.count("*").alias("days"), F.max_by("cum", "i").cast("double").alias("total"), F.regr_slope(F.col("cum").cast("double"), F.col("i").cast("double")).alias("slope"))
    out = out.where(F.col("days") >= least)
    return out.withColumn("score", F.when(F.col("total") > 0, 2).otherwise(0) + F.when(F.col("slope") > 0, 2).otherwise(0))


def dense_series(net: DataFrame, entity: str, top: int = 12) -> DataFrame:
    """The entities with the largest absolute total, on every date of the table, gaps filled with 0."""
    total = net.groupBy(entity).agg(F.sum("net").alias("total"))
    best = total.orderBy(F.desc(F.abs("total")), entity).limit(top).select(entity)
    grid = net.select("date").distinct().crossJoin(F.broadcast(best))  # ``top`` rows a date
    per = net.groupBy("date", entity).agg(F.sum("net").alias("net"))
    return grid.join(per, ["date", entity], "left").withColumn("net", F.coalesce("net", F.lit(0)))


def breadth_quadrants(net: DataFrame) -> DataFrame:
    """Net, total and breadth by broker; quadrant against the upper median breadth."""
    b = net.groupBy("broker").agg(F.sum("net").alias("net"), F.sum(F.col("buy") + F.col("sell")).alias("total"), F.count_distinct("ticker").alias("breadth"))
    # from above, so that of two middle values the larger one counts; the buffer holds counts by value
    n = b.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY breadth DESC)").cast("long").alias("median"))
    b = b.crossJoin(F.broadcast(n))  # one row
    wide = F.col("breadth") >= F.col("median")
    q = F.when((F.col("net") >= 0) & wide, "Q1").when((F.col("net") < 0) & wide, "Q2").when(F.col("net") < 0, "Q3").otherwise("Q4")
    return b.withColumn("quadrant", q)


def concentration(net: DataFrame) -> DataFrame:
    """Share of each broker in its ticker's turnover, and the share of brokers on the same side."""
    t = W.partitionBy("ticker")
    turnover = F.col("buy") + F.col("sell")
    out = net.withColumn("share", ratio(turnover, F.sum(turnover).over(t)))
    side = F.when(F.col("net") >= 0, 1.0).otherwise(0.0)
    buyers = F.avg(side).over(t)
    return out.withColumn("herding", F.when(F.col("net") >= 0, buyers).otherwise(1 - buyers) * 100)


def interbroker(rows: DataFrame, active_days: int | Column) -> DataFrame:
    """Conviction, share, persistence and herding of broker-ticker rows with net, total and streak.

    conviction: |net| of the row's turnover. cr_pct: |net| of the ticker's sum
    of |net|. persistence: |streak| of the active days. herd_pct: brokers of
    the ticker on the row's side; 0 for a net of 0 or a single broker.
    """
    t = W.partitionBy("ticker")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    net = F.col("net")
    n, buyers, sellers = F.count("*").over(t), F.count_if(net > 0).over(t), F.count_if(net < 0).over(t)
    days = active_days if isinstance(active_days, Column) else F.lit(active_days)
    return rows.withColumns(
        {
            "conviction": zero(ratio(F.abs(net), F.col("total"))),
            "cr_pct": zero(ratio(F.abs(net), F.sum(F.abs(net)).over(t))),
            "persistence": zero(ratio(F.abs(F.coalesce("streak", F.lit(0))), days)),
            "herd_pct": F.when((n < 2) | (net == 0), 0.0).otherwise(F.when(net > 0, buyers).otherwise(sellers) / n),
        }
    )


def cross_section_z(net: DataFrame) -> DataFrame:
    """z of net within the broker (two values at least) and across the ticker's brokers (three at least)."""
    from tapeloom.functions.scalars import zscore

    x = F.col("net").cast("double")
    out = net
    for key, least in (("broker", 2), ("ticker", 3)):
        w = W.partitionBy(key)
        n = F.count(x).over(w)
        z = zscore(x, F.avg(x).over(w), F.stddev_pop(x).over(w), n)
        out = out.withColumn(f"z_{key}", F.when(n >= least, z))
    return out
