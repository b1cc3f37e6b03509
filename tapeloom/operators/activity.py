"""Broker activity over time: momentum, streaks, trends, ranks; order-book pressure; hot scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import clamp, half_up, ratio
from tapeloom.operators.rolling import mid_rank
from tapeloom.operators.scoring import first_match

ORDER = (2, 5, 10, 20)


def relation(values: dict[int, Column], mode: str) -> Column:
    """``2gt5`` .. ``10gt20``, ``ladderUp``, ``allPos``, ``allNeg`` or ``any`` over window values; a null fails all but ``any``."""
    if mode == "any":
        return F.lit(True)
    v = [values[w].cast("double") for w in ORDER]
    present = F.forall(F.array(*v), lambda x: x.isNotNull() & ~F.isnan(x))
    if mode == "ladderUp":
        holds = (v[0] >= v[1]) & (v[1] >= v[2]) & (v[2] >= v[3])
    elif mode in ("allPos", "allNeg"):
        holds = F.forall(F.array(*v), lambda x: x > 0 if mode == "allPos" else x < 0)
    else:
        a, b = map(int, mode.split("gt"))
        holds = values[a] > values[b]
    return present & F.coalesce(holds, F.lit(False))


def trend_score(sums: dict[int, Column]) -> Column:
    """-4..4: daily averages of shorter windows against longer ones, and the sign of the shortest."""
    per = {w: sums[w] / w for w in ORDER}
    sign = lambda x: F.signum(x).cast("int")
    return sign(per[2] - per[5]) + sign(per[5] - per[10]) + sign(per[10] - per[20]) + sign(sums[2])


def momentum(net: DataFrame, key: list[str]) -> DataFrame:
    """-100..100 by key from daily buy, sell and net: money flow, smoothed conviction and its change."""
    day = F.struct("date", F.coalesce(ratio(F.col("net"), F.col("buy") + F.col("sell")), F.lit(0.0)).alias("c"))
    g = net.groupBy(*key).agg(F.sum("buy").cast("double").alias("b"), F.sum("sell").cast("double").alias("s"), F.transform(F.array_sort(F.collect_list(day)), lambda x: x["c"]).alias("c"))
    n = F.size("c")
    r = F.when(F.col("s") > 0, F.try_divide(F.col("b"), F.col("s"))).when(F.col("b") > 0, 10.0).otherwise(1.0)
    mfi = (100 - 100 / (1 + r) - 50) * 2
    alpha = F.lit(2.0) / (n + 1)
    ema = F.aggregate(F.slice("c", 2, F.greatest(n - 1, F.lit(0))), F.get("c", 0), lambda a, x: alpha * x + (1 - alpha) * a)
    third = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / third
    roc = F.when(n >= 3, mean(F.slice("c", n - third + 1, third)) - mean(F.slice("c", F.lit(1), third))).otherwise(0.0)
    score = 0.4 * mfi + 0.4 * ema * 100 + 0.2 * clamp(roc * 100, -100.0, 100.0)
    return g.select(*key, n.alias("days"), clamp(score, -100.0, 100.0).alias("momentum"))


def calendar_streak(net: DataFrame, calendar: DataFrame, key: list[str]) -> DataFrame:
    """Newest run of one sign over calendar days: idle days at the end are skipped, later ones end the run.

    ``calendar`` has date and day_index. Consecutive active days have
    consecutive indexes, so no grid of keys and days is built.
    """
    active = net.where("net <> 0").join(calendar.select("date", "day_index"), "date")
    newest = W.partitionBy(*key).orderBy(F.desc("day_index"))
    a = active.withColumn("_s", F.signum("net").cast("int")).withColumn("_k", F.row_number().over(newest))
    a = a.withColumn("_first", F.first("_s").over(newest)).withColumn("_top", F.first("day_index").over(newest))
    goes_on = (F.col("_s") == F.col("_first")) & (F.col("_top") - F.col("day_index") == F.col("_k") - 1)
    a = a.withColumn("_run", F.min(goes_on.cast("int")).over(newest.rowsBetween(W.unboundedPreceding, 0)))
    found = a.groupBy(*key).agg((F.max("_first") * F.sum("_run")).alias("streak"))
    return net.select(*key).distinct().join(found, key, "left").withColumn("streak", F.coalesce("streak", F.lit(0).cast("long")))


def rank_trail(points: DataFrame, key: str, minute: str, value: str, top: int) -> DataFrame:
    """Rank at each minute, its change from the minute before, and for how many minutes on end it is in the top."""
    r = points.withColumn("rank", F.row_number().over(W.partitionBy(minute).orderBy(F.desc(value), key))).where(F.col("rank") <= top)
    w = W.partitionBy(key).orderBy(minute)
    slot = F.floor(F.unix_timestamp(F.col(minute).cast("timestamp")) / 3600) - F.row_number().over(w)
    r = r.withColumn("_island", slot)
    r = r.withColumn("presence", F.row_number().over(W.partitionBy(key, "_island").orderBy(minute)))
    return r.withColumn("rank_delta", F.lag("rank").over(W.partitionBy(key, "_island").orderBy(minute)) - F.col("rank")).drop("_island")


def rank_trend(ranked: DataFrame, key: str, minute: str, back: int = 5, points: int = 10) -> DataFrame:
    """Change of the rank over the last ``back`` points that a key has, and its slope over the last ``points``.

    Minutes without a rank do not count. Both are negative where the rank
    improves, and 0 with too few points (two for the change, three for the slope).
    """
    w = W.partitionBy(key).orderBy(minute)
    at, last = F.row_number().over(w).cast("double"), w.rowsBetween(1 - points, 0)
    r = ranked.withColumn("_i", at)
    slope = F.when(F.count("*").over(last) >= 3, F.regr_slope(F.col("rank").cast("double"), F.col("_i")).over(last)).otherwise(0.0)
    return r.withColumn("rank_change", F.col("rank") - F.first("rank").over(w.rowsBetween(-back, 0))).withColumn("rank_slope", slope).drop("_i")


def scaled(x: Column, low: float, high: float) -> Column:
    """0..100 within low..high."""
    return clamp((x - low) / (high - low) * 100, 0.0, 100.0)


def book_pressure(ticks: DataFrame, window: int = 60, key: str = "instrument", order: str = "ts") -> DataFrame:
    """Bid support and ask thinning of the last book snapshots, with pressure index and traffic light.

    Needs bid5, ask5 (quantities of five levels), best_bid and best_ask.
    Null scores with fewer than two snapshots.
    """
    w = W.partitionBy(key).orderBy(order)
    last = w.rowsBetween(-(window - 1), 0)
    moves = w.rowsBetween(-(window - 2), 0)
    spread = F.when(F.col("best_bid") > 0, (F.col("best_ask") - F.col("best_bid")) / F.col("best_bid") * 10_000).otherwise(20.0)
    # the quantities of a window in columns of their own: _ask1 is that of the snapshot before
    asks = ["ask5", *[f"_ask{k}" for k in range(1, window)]]
    t = ticks.withColumns({"spread_bps": spread, "_bid": F.lag("bid5").over(w), "_best": F.lag("best_bid").over(w), **{c: F.lag("ask5", k).over(w) for k, c in enumerate(asks) if k}})
    flags = {"_up": F.col("bid5") > F.col("_bid"), "_same": F.col("best_bid") == F.col("_best"), "_down": F.col("ask5") < F.col("_ask1")} if window > 1 else dict.fromkeys(("_up", "_same", "_down"), F.lit(None))
    t = t.withColumns({c: x.cast("double") for c, x in flags.items()})
    over = {"_n": F.count(F.lit(1)), "_known": F.count("ask5"), "_bid_first": F.first("bid5"), "_ask_first": F.first("ask5"), "_spread": F.avg("spread_bps")}
    t = t.withColumns({**{c: x.over(last) for c, x in over.items()}, **{f"{c}_mean": F.avg(c).over(moves) for c in flags}})
    # nulls, also those of places before the first snapshot, come first; the median counts them last
    upper = F.get(F.sort_array(F.array(*asks)), (F.lit(window) - F.col("_known") + F.floor(F.col("_n") / 2)).cast("int"))
    t = t.withColumn("_wall", F.coalesce(F.nullif(upper, F.lit(0.0)), F.lit(1.0)) * 1.5)
    # an ask that grew to a wall since the snapshot before it, within the window
    walls = sum((F.coalesce((F.col(b) < F.col(a)) & (F.col(a) >= F.col("_wall")), F.lit(False)).cast("int") for a, b in zip(asks, asks[1:])), F.lit(0))
    bid_delta = F.when(F.col("_bid_first") > 0, (F.col("bid5") - F.col("_bid_first")) / F.col("_bid_first") * 100).otherwise(0.0)
    ask_drop = F.when(F.col("_ask_first") > 0, (F.col("_ask_first") - F.col("ask5")) / F.col("_ask_first") * 100).otherwise(0.0)
    penalty = clamp(walls / F.greatest(F.col("_n") - 1, F.lit(1)) * 200, 0.0, 100.0)
    bss = 0.45 * scaled(bid_delta, -10, 40) + 0.35 * scaled(F.col("_up_mean"), 0.0, 1.2) + 0.20 * scaled(F.col("_same_mean"), 0.2, 1.0)
    ats = 0.45 * scaled(ask_drop, -10, 40) + 0.35 * scaled(F.col("_down_mean"), 0.0, 1.2) + 0.20 * (100 - penalty)
    two = F.col("_n") >= 2
    t = t.withColumns({"bss": F.when(two, clamp(bss, 0.0, 100.0)), "ats": F.when(two, clamp(ats, 0.0, 100.0)), "spread_avg": F.col("_spread")})
    t = t.withColumns({"light": book_light(F.col("bss"), F.col("ats")), "pressure": pressure(F.col("bss"), F.col("ats"), F.col("spread_avg"))})
    return t.drop(*asks[1:], *flags, *[f"{c}_mean" for c in flags], *over, "_bid", "_best", "_wall")


def book_light(bss: Column, ats: Column) -> Column:
    return first_match([((bss >= 65) & (ats >= 65), "GREEN_GREEN"), ((bss >= 65) & (ats >= 45), "GREEN_YELLOW"), ((bss >= 45) & (ats < 45), "YELLOW_RED")], "RED_RED")


def pressure(bss: Column, ats: Column, spread_bps: Column, widest: float = 100.0) -> Column:
    """0.4 bid support + 0.4 ask thinning + 0.2 spread health."""
    return 0.4 * bss + 0.4 * ats + 0.2 * clamp(100 - spread_bps / widest * 100, 0.0, 100.0)


#: Weights of the hot score: percentiles and slopes add, penalties take off.
HOT = {"M": 0.10, "V": 0.10, "P": 0.20, "Ps": 0.10, "C": 0.20, "Cs": 0.10, "B": 0.10, "O": 0.10, "Div": -0.25, "Extreme": -0.10}


def hot_score(d: DataFrame, by: list[str]) -> DataFrame:
    """0..100 with stage, per roster ``by``.

    Needs chg, value, pressure, cvd, p_slope, c_slope, bss, ats (0..100, null:
    50) and divergent. A score above 70 needs strong pressure, a strong side
    of the book and no divergence.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    half = lambda c: F.coalesce(F.col(c) / 100.0, F.lit(0.5))
    w = W.partitionBy(*by)
    chg = zero("chg")
    sd = F.coalesce(F.nullif(F.stddev_pop(F.abs(chg)).over(w), F.lit(0.0)), F.lit(1.0))
    clash = (F.abs(chg) > 1.5) & (F.abs(zero("cvd")) > 50) & (F.signum(chg) * F.signum(zero("cvd")) < 0)
    d = d.withColumns({"_chg": chg, "_value": zero("value"), "_p": F.coalesce(F.col("pressure").cast("double"), F.lit(50.0)), "_cvd": zero("cvd")})
    parts = {
        "M": mid_rank(F.col("_chg"), by),
        "V": mid_rank(F.col("_value"), by),
        "P": mid_rank(F.col("_p"), by),
        "C": mid_rank(F.col("_cvd"), by),
        "Ps": clamp((zero("p_slope") + 2) / 4, 0.0, 1.0),
        "Cs": clamp((zero("c_slope") + 2) / 4, 0.0, 1.0),
        "B": half("bss"),
        "O": half("ats"),
        "Div": (F.coalesce("divergent", F.lit(False)) | clash).cast("double"),
        "Extreme": (F.abs(chg) > F.avg(F.abs(chg)).over(w) + 2 * sd).cast("double"),
    }
    d = d.withColumns({f"_{k}": v for k, v in parts.items()})
    raw = F.lit(0.0)
    for k, weight in HOT.items():
        raw = raw + weight * F.col(f"_{k}")
    score = half_up(100 * clamp(raw, 0.0, 1.0))
    passes = (F.col("_P") > 0.6) & ((F.col("_B") > 0.6) | (F.col("_O") > 0.6)) & (F.col("_Div") == 0)
    d = d.withColumn("hot", F.when((score > 70) & ~passes, F.least(score, F.lit(69.0))).otherwise(score))
    d = d.withColumn("stage", first_match([(F.col("hot") >= 70, "Strong Continuation"), (F.col("hot") >= 50, "Watch")], "Cooling"))
    return d.withColumn("reasons", reasons({k: F.col(f"_{k}") for k in ("M", "V", "P", "C", "B", "O")})).drop("_chg", "_value", "_p", "_cvd", *[f"_{k}" for k in parts])


def reasons(parts: dict[str, Column], threshold: float = 0.6, most: int = 6, least: int = 2) -> Column:
    """Names of the strongest parts, at most ``most``; padded with NEUTRAL to ``least``."""
    every = F.array(*[F.struct((-v).alias("w"), F.lit(k).alias("k")) for k, v in parts.items()])
    strong = F.transform(F.slice(F.array_sort(F.filter(every, lambda x: x["w"] < -threshold)), 1, most), lambda x: x["k"])
    return F.concat(strong, F.slice(F.array_repeat(F.lit("NEUTRAL"), least), 1, F.greatest(F.lit(0), least - F.size(strong))))


def on_demand_features(day_rows: DataFrame, key: str = "instrument") -> DataFrame:
    """Averages, price change, elasticity and state of each key's days, from the newest against the oldest five."""
    w = W.partitionBy(key)
    d = day_rows.withColumn("_up", F.row_number().over(w.orderBy("date"))).withColumn("_down", F.row_number().over(w.orderBy(F.desc("date"))))
    part = lambda c, k: F.sum(F.when(F.col(k) <= 5, F.col(c)))
    g = d.groupBy(key).agg(
        F.count("*").alias("days"),
        F.avg("vol").alias("avg_vol"),
        F.min_by("close", "date").alias("a"),
        F.max_by("close", "date").alias("z"),
        F.avg(ratio(F.col("delta") * 100, F.when(F.col("vol") > 0, F.col("vol")).otherwise(1))).alias("avg_delta_pct"),
        part("delta", "_down").alias("recent"),
        part("delta", "_up").alias("early"),
    )
    change = F.coalesce(ratio((F.col("z") - F.col("a")) * 100, F.when(F.col("a") > 0, F.col("a"))), F.lit(0.0))
    g = g.withColumn("price_change", change)
    g = g.withColumn("elasticity", F.coalesce(ratio(F.col("price_change"), F.col("avg_vol") / 1_000_000), F.lit(0.0)))
    r, e, p = F.col("recent"), F.col("early"), F.col("price_change")
    state = first_match([((r > e * 1.5) & (r > 0), "ACCUMULATION"), ((r < e * 0.5) & (r < 0), "DISTRIBUTION"), ((r > 0) & (p > 2), "READY_MARKUP"), ((r < 0) & (p < -2), "POTENTIAL_TOP")], "NEUTRAL")
    return g.withColumn("state", state).drop("a", "z")


#: Feature -> (source, value at -3, value at 3).
FEATURE_RANGES = {"effort": ("avg_vol", 0.0, 1e7), "response": ("price_change", -10.0, 10.0), "quality": ("avg_delta_pct", -50.0, 50.0), "elasticity_z": ("elasticity", -1.0, 1.0)}


def scaled_features(day_rows: DataFrame, most: int = 20, least: int = 5, key: str = "instrument") -> DataFrame:
    """State and features in -3..3 of each key's newest ``most`` days; keys with fewer than ``least`` are left out."""
    newest = W.partitionBy(key).orderBy(F.desc("date"))
    recent = day_rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= most).drop("_k")
    f = on_demand_features(recent, key).where(F.col("days") >= least)
    return f.withColumns({n: clamp((F.col(c) - low) / (high - low) * 6 - 3, -3.0, 3.0) for n, (c, low, high) in FEATURE_RANGES.items()})


def flow_features(flow: DataFrame, least: int = 5) -> DataFrame:
    """The same question asked of broker flow: state and features in -3..3 from each ticker's days.

    Tickers with fewer than ``least`` days are neutral and all 0. Missing
    prices are 0 and left out of the average.
    """
    w = W.partitionBy("ticker")
    d = flow.withColumn("_up", F.row_number().over(w.orderBy("date"))).withColumn("_down", F.row_number().over(w.orderBy(F.desc("date"))))
    part = lambda k: F.sum(F.when(F.col(k) <= 5, F.col("smart_net")).otherwise(0))
    g = d.groupBy("ticker").agg(
        F.count("*").alias("days"),
        F.avg(F.col("total_value").cast("double")).alias("_value"),
        F.min_by("price", "date").alias("_a"),
        F.max_by("price", "date").alias("_z"),
        F.avg(F.when(F.col("price") > 0, F.col("price"))).alias("_mean"),
        F.sum("smart_net").cast("double").alias("_total"),
        F.max(F.abs("smart_net")).cast("double").alias("_most"),
        part("_down").cast("double").alias("_recent"),
        part("_up").cast("double").alias("_early"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    g = g.withColumn("_change", zero(ratio((F.col("_z") - F.col("_a")) * 100, F.when(F.col("_a") > 0, F.col("_a")))))
    enough = F.col("days") >= least
    scale = lambda x, top: F.when(enough, clamp(x / top * 3, -3.0, 3.0)).otherwise(0.0)
    r, e, p = F.col("_recent"), F.col("_early"), F.col("_change")
    state = first_match([(~enough, "NEUTRAL"), ((r > 0) & (r > e * 1.2), "ACCUMULATION"), ((r < 0) & (r < e * 0.8), "DISTRIBUTION"), ((r > 0) & (p > 3), "READY_MARKUP"), ((r < 0) & (p < -3), "POTENTIAL_TOP")], "NEUTRAL")
    most = F.coalesce(F.nullif(F.col("_most"), F.lit(0.0)), F.lit(1.0))
    off = zero(ratio((F.col("_z") - F.col("_mean")) * 100, F.when(F.col("_z") > 0, F.col("_mean"))))
    return g.select(
        "ticker",
        "days",
        scale(F.col("_value"), 5e9).alias("effort"),
        scale(p, 10).alias("response"),
        scale(F.col("_total") / F.col("days"), most).alias("quality"),
        scale(off, 5).alias("vwap"),
        scale(zero(ratio(p, F.col("_total") / 1_000_000)), 5).alias("elasticity"),
        state.alias("state"),
    )
