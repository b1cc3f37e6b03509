"""Scores, signals and labels, as column expressions over feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalars import clamp, half_up, ratio, sigmoid, unit
from tapeloom.operators.rolling import average_rank


def first_match(cases: list, default) -> Column:
    """The value of the first case that holds; a case is (condition, value)."""
    out = F.lit(default)
    for cond, value in reversed(cases):
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def divergence_factor(state: Column, delta: Column, z: Column) -> Column:
    """0.5 .. 1.2: how far the day's delta contradicts or confirms the state of the days before."""
    acc, dis = state == "ACCUMULATION", state == "DISTRIBUTION"
    return first_match(
        [
            (dis & (delta > 5), 0.5),
            (dis & (delta > 0) & (z < -0.5), 0.6),
            (acc & (delta < -5), 0.7),
            (acc & (delta > 5) & (z > 0.5), 1.2),
            (acc & (delta > 0) & (z > 0.5), 1.1),
            (dis & (delta < -5), 1.0),
            ((state == "TRANSITION") & (delta > 5), 0.9),
        ],
        1.0,
    )


def signal_with_divergence(score, delta, z, state, price, factor, kind) -> Column:
    acc = state == "ACCUMULATION"
    return first_match(
        [
            (price < -5, "SELL"),
            (kind == "RETAIL_TRAP", "RETAIL_TRAP"),
            ((kind == "SM_DIVERGENCE") & (score > 0.4), "SM_DIVERGENCE"),
            ((score > 0.7) & acc & (price >= -2) & (factor >= 1.0), "STRONG_BUY"),
            ((score > 0.6) & (factor >= 1.1) & acc, "CONFIRMED_ACCUM"),
            ((delta > 80) & (z < -0.5), "TRAP_WARNING"),
            ((delta < 40) & (z > 0.7) & acc, "HIDDEN_ACCUM"),
            ((score < 0.3) & (state == "DISTRIBUTION"), "STRONG_SELL"),
            ((score > 0.6) & (price >= -3) & (factor >= 0.9), "BUY"),
            ((score > 0.5) & (price >= -3) & (factor >= 0.7), "WATCH"),
            (score < 0.4, "SELL"),
        ],
        "NEUTRAL",
    )


def hybrid_daily(d: DataFrame) -> DataFrame:
    """Daily hybrid score; needs delta_pct, price_pct, ctx_found, ctx_state, ctx_z (null context: neutral).

    70 % delta and 30 % context, weighed by the price move, times the
    divergence factor; rows without volume or open have no percentages and are
    left out, and so are those whose ``close`` (if there is one) is 0.
    """
    delta, price = F.col("delta_pct"), F.col("price_pct")
    d = d.where("delta_pct IS NOT NULL AND price_pct IS NOT NULL")
    if "close" in d.columns:
        d = d.where("close <> 0")
    state, z = F.coalesce("ctx_state", F.lit("NEUTRAL")), F.coalesce("ctx_z", F.lit(0.0))
    base = 0.3 * unit(z, -3, 3) + 0.7 * unit(delta, -100, 100)
    base = F.when(price < -4, base * 0.5).when(price.between(-1, 2), base * 1.1).otherwise(base)
    d = d.withColumn("base_score", F.least(F.lit(1.0), base))
    d = d.withColumn("factor", F.when(F.col("ctx_found"), divergence_factor(state, delta, z)).otherwise(1.0))
    d = d.withColumn("score", clamp(F.col("base_score") * F.col("factor"), 0.0, 1.0))
    f, s = F.col("factor"), F.col("score")
    kind = F.when(f <= 0.5, "RETAIL_TRAP").when((f <= 0.7) & (state == "DISTRIBUTION"), "SM_DIVERGENCE").when((f <= 0.7) & (state == "ACCUMULATION"), "SHAKEOUT")
    d = d.withColumn("div_type", kind)
    sig = signal_with_divergence(s, delta, z, state, price, f, F.coalesce("div_type", F.lit("")))
    watch = (~F.col("ctx_found") | (state == "NEUTRAL")) & (unit(delta, -100, 100) > 0.8) & (s > 0.6) & (price >= -3)
    return d.withColumn("signal", F.when(watch, "WATCH_ACCUM").otherwise(sig))


def hybrid_range(d: DataFrame) -> DataFrame:
    """Hybrid score of a date range: 70 % real-time (delta ±25, price ±5), 30 % context with a bonus by state."""
    delta, price = F.col("delta_pct"), F.col("price_pct")
    d = d.where("delta_pct IS NOT NULL AND price_pct IS NOT NULL")
    state, z = F.coalesce("ctx_state", F.lit("NEUTRAL")), F.coalesce("ctx_z", F.lit(0.0))
    now = 0.7 * unit(delta, -25, 25) + 0.3 * unit(price, -5, 5)
    bonus = F.when(state == "ACCUMULATION", 0.1).when(state == "DISTRIBUTION", -0.1).otherwise(0.0)
    d = d.withColumn("score", 0.7 * now + 0.3 * clamp(unit(z, -3, 3) + bonus, 0.0, 1.0))
    s, acc, dis = F.col("score"), state == "ACCUMULATION", state == "DISTRIBUTION"
    sig = first_match(
        [
            (acc & (delta > 0) & (s > 0.75), "STRONG_BUY"),
            ((delta > 0) & (price > 0) & (s > 0.8), "MARKUP"),
            (dis & (delta > 0), "TRAP_WARNING"),
            ((price <= 0) & (delta > 0) & acc, "HIDDEN_ACCUM"),
            (dis & (delta < 0) & (s < 0.25), "STRONG_SELL"),
            (s > 0.6, "BUY"),
            (s < 0.4, "SELL"),
        ],
        "NEUTRAL",
    )
    return d.withColumn("signal", sig)


def flow_score(effort: Column, ngr: Column, state: Column) -> Column:
    bonus = F.when(state.isin("ACCUMULATION", "READY_MARKUP"), 2).when(state == "TRANSITION", 1).otherwise(0)
    return F.when(effort > 0, F.least(effort * 2, F.lit(4.0))).otherwise(0.0) + bonus + F.when(ngr > 0, 1).otherwise(0)


def _centred(x: Column, by: list[str], gate: bool = True) -> Column:
    """Percentile scaled to -1..1; of a value that is not positive, at most 0."""
    p = clamp(average_rank(x, by) * 2 - 1, -1.0, 1.0)  # 0 for a missing value
    return F.when(x.isNull(), 0.0).when(x <= 0, F.least(F.lit(0.0), p)).otherwise(p) if gate else p


STATE_BONUS = {"READY_MARKUP": 0.10, "ACCUMULATION": 0.06, "TRANSITION": 0.02}


def probability(d: DataFrame, parts: list, by: list[str], liquidity: str, trend: Column | None = None, name: str = "prob") -> DataFrame:
    """5..90 from weighted percentiles; ``parts`` are (weight, [(weight, column, gated)]). Distribution is 5.

    The percentiles need all rows of a date: ``by`` names it, so that dates
    are ranked apart and in parallel.
    """
    total = F.lit(0.0)
    for weight, inner in parts:
        one = F.lit(0.0)
        for w, c, gate in inner:
            one = one + w * _centred(F.col(c), by, gate)
        total = total + weight * one
    liq = clamp((average_rank(F.col(liquidity), by) - 0.10) / 0.40, 0.0, 1.0)
    bonus = first_match([(F.col("state") == s, v) for s, v in STATE_BONUS.items()], 0.0)
    raw = liq * total + bonus + (trend if trend is not None else F.lit(0.0))
    d = d.withColumn(f"{name}_raw", F.when(F.col("state") == "DISTRIBUTION", 0.0).otherwise(raw))
    score = clamp(half_up(5 + 85 * sigmoid(4 * F.col(f"{name}_raw"))), 5.0, 90.0)
    d = d.withColumn(name, F.when(F.col("state") == "DISTRIBUTION", 5.0).otherwise(score))
    s = F.col(name)
    label = first_match([(F.col("state") == "DISTRIBUTION", "DISQ"), (s >= 70, "HIGH"), (s >= 50, "MED"), (s >= 35, "LOW")], "VLOW")
    return d.withColumn(f"{name}_label", label)


def with_freshness(d: DataFrame, name: str, fresh: Column) -> DataFrame:
    """Score and raw null and label NA where the inputs of ``name`` are missing or too old."""
    fresh = F.coalesce(fresh, F.lit(False))
    keep = lambda c: F.when(fresh, F.col(c))
    return d.withColumns({name: keep(name), f"{name}_raw": keep(f"{name}_raw"), f"{name}_label": F.coalesce(keep(f"{name}_label"), F.lit("NA"))})


#: Inputs of the two-day and the five-day probability: (weight, [(weight, column, gated by its sign)]).
TWO_DAYS = [
    (0.45, [(0.7, "sm2", True), (0.2, "sm5", True), (0.1, "sm10", True)]),
    (0.35, [(0.25, "order_mom_pct", True), (0.25, "order_delta_pct", True), (0.25, "order_absorb", False), (0.25, "order_cvd", True)]),
    (0.20, [(0.7, "eff2", False), (0.3, "eff5", False)]),
]
FIVE_DAYS = [
    (0.35, [(0.5, "sm5", True), (0.3, "sm10", True), (0.2, "sm20", True)]),
    (0.20, [(0.6, "flow5", False), (0.4, "flow10", False)]),
    (0.15, [(0.6, "eff5", False), (0.4, "eff10", False)]),
    (0.15, [(0.7, "vwap5", False), (0.3, "vwap10", False)]),
    (0.15, [(0.6, "cvd_pct_5d", True), (0.4, "cvd_pct_10d", True)]),
]


def two_day_probability(d: DataFrame, by: list[str], fresh: Column) -> DataFrame:
    """TOM2: needs netv, state and the columns of TWO_DAYS; ``fresh`` says whether the order flow is recent.

    Momentum and delta must be there, and one of absorption, running delta
    and order_net_value (if there).
    """
    depth = [F.col(c).isNotNull() for c in ("order_absorb", "order_cvd", "order_net_value") if c in d.columns]
    there = F.col("order_mom_pct").isNotNull() & F.col("order_delta_pct").isNotNull() & F.greatest(*depth, F.lit(False))
    return with_freshness(probability(d, TWO_DAYS, by, "netv", name="tom2"), "tom2", fresh & there)


def five_day_probability(d: DataFrame, by: list[str], fresh: Column) -> DataFrame:
    """SWG5: needs netv, state, vwap_up and the columns of FIVE_DAYS; a rising VWAP adds 0.05."""
    there = F.lit(True)
    for c in ("sm5", "sm10", "sm20", "eff5", "eff10", "vwap5", "vwap10"):
        there = there & F.col(c).isNotNull()
    trend = F.when(F.col("vwap_up"), 0.05).otherwise(0.0)
    return with_freshness(probability(d, FIVE_DAYS, by, "netv", trend, name="swg5"), "swg5", fresh & there)


def quality_issues(d: DataFrame) -> DataFrame:
    """Issues and severity of a broker-flow row.

    Whatever makes the row incomplete is critical: no price, an empty side,
    value without brokers, trades (``freq``, if there) without value. A price
    jump of more than 35 % alone is a warning. Missing numbers count as 0.
    """
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in d.columns else F.lit(0.0)
    jump = F.abs(ratio(n("price") - n("prev_price"), n("prev_price"))) > 0.35
    tests = [
        ("NO_PRICE", n("price") <= 0),
        ("NO_BUYERS", n("buyers") == 0),
        ("NO_SELLERS", n("sellers") == 0),
        ("VALUE_WITHOUT_BROKERS", (n("total_value") > 0) & (n("buyers") + n("sellers") == 0)),
        ("FREQUENCY_WITHOUT_VALUE", (n("freq") > 0) & (n("total_value") <= 0)),
        ("PRICE_JUMP", (n("price") > 0) & (n("prev_price") > 0) & F.coalesce(jump, F.lit(False))),
    ]
    d = d.withColumn("issues", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))
    critical = F.size(F.array_except("issues", F.array(F.lit("PRICE_JUMP")))) > 0
    return d.withColumn("severity", F.when(critical, "CRITICAL").when(F.size("issues") > 0, "WARNING").otherwise("OK"))


def session_completeness(now: Column, opens: int, closes: int, width: int = 5, stale_minutes: int = 20, early: int = 10) -> Column:
    """State of a day row with date, traded (buckets with volume) and last_bucket, seen at ``now``.

    A session lasts from minute ``opens`` to ``closes`` of the day, both whole
    hours, in buckets of ``width`` minutes. A past day should have half of all
    buckets and end at most ``early`` minutes before the close; today should
    have half of those up to now, and inside the session a bucket in the last
    ``stale_minutes``. Nothing is expected of today before the open or on a
    weekend. At least five buckets are expected where any are.
    """
    minute = F.hour(now) * 60 + F.minute(now)
    today, weekend = F.col("date") == F.to_date(now), F.dayofweek(now).isin(1, 7)
    elapsed = F.least(minute, F.lit(closes)) - opens
    expected = F.when(~today, (closes - opens) // width).when(~weekend & (minute >= opens), F.floor(elapsed / width)).otherwise(0)
    traded = F.coalesce(F.col("traded"), F.lit(0))
    sparse = (expected > 0) & (traded < F.greatest(F.floor(expected / 2), F.lit(5)))
    last = F.hour("last_bucket") * 60 + F.minute("last_bucket")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("last_bucket").cast("timestamp"))
    stale = today & ~weekend & (minute >= opens) & (minute < closes) & (age > stale_minutes * 60)
    return first_match([(traded == 0, "NO_DATA"), (sparse, "SPARSE_DATA"), (~today & (last < closes - early), "PAST_DAY_INCOMPLETE"), (stale, "TODAY_STALE")], "COMPLETE")
