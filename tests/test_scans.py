"""Two-level scans give the rows of their one-level forms, also with one hot key over many parts."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators import relational, rolling, scans


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows: two thirds of one key, a null key, nulls among the values, over 100 days."""
    draw = random.Random(4)
    rows = []
    for i in range(3000):
        key = draw.choice(["hot", "hot", "hot", "hot", "a", "b", None])
        rows.append((key, i // 30, i, draw.choice([None, 1, 2, 5, 5]), round(draw.uniform(1, 9), 2)))
    df = spark.createDataFrame(rows, "k string, d int, i int, x long, p double")
    return df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))).repartition(5)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum_and_last_known_equal_a_window(spark, hot, inclusive):
    w = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    part = F.date_trunc("week", "date")
    same(scans.running_sum(hot, ["k"], ["i"], part, F.col("x"), "s", inclusive), hot.withColumn("s", F.coalesce(F.sum("x").over(w), F.lit(0))))
    same(scans.last_known(hot, ["k"], ["i"], part, F.col("x"), "s", inclusive), hot.withColumn("s", F.last("x", ignorenulls=True).over(w)))
    empty = hot.limit(0)
    assert scans.running_sum(empty, ["k"], ["i"], part, F.col("x"), "s").count() == scans.last_known(empty, ["k"], ["i"], part, F.col("x"), "s").count() == 0


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_in_parts_equals_one_pass(spark, hot, strict):
    left = hot.where("i % 3 = 0").select("k", "date", "i")
    right = hot.where("i % 3 = 1 AND i % 7 < 4").groupBy("k", "date").agg(F.max("p").alias("known"), F.min("x").alias("least"))
    same(scans.as_of_parts(left, right, "k", "date", "week", strict), relational.as_of(left, right, "k", "date", strict))


def test_no_scan_of_rows_is_by_key_alone(spark, hot):
    plan = scans.running_sum(hot, ["k"], ["i"], F.date_trunc("week", "date"), F.col("x"), "s")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    by_key = [line for line in windows if "_part" not in line.partition("specifiedwindowframe")[0] and "_total" not in line]
    assert len(windows) >= 2 and by_key == [], by_key  # rows by (key, part); by key only the parts' totals


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 1000])
def test_composed_maps(n):
    draw = np.random.default_rng(n)
    a, b, x = draw.uniform(-1, 1, n), draw.normal(size=n), 0.7
    ca, cb = scans.composed(a, b)
    for i in range(n):
        x = a[i] * x + b[i]
        assert ca[i] * 0.7 + cb[i] == pytest.approx(x, abs=1e-12)


def test_affine_scan_equals_a_loop(spark, hot):
    rows = hot.withColumn("c", F.when(F.col("i") % 4 == 0, 0.0).otherwise(0.9))
    got = scans.affine_scan(rows, ["k"], ["i"], F.date_trunc("week", "date"), {"u": (F.col("c"), F.col("p")), "v": (F.lit(1.0), F.lit(1.0))}).orderBy("i").collect()
    state, n = {}, {}
    for r in got:
        state[r.k] = r.c * state.get(r.k, 0) + r.p
        n[r.k] = n.get(r.k, 0) + 1
        assert r.u == pytest.approx(state[r.k], rel=1e-12) and r.v == n[r.k]
    assert len(got) == 3000


def test_rsi_of_the_newest_row_equals_the_fold(spark):
    draw = random.Random(9)
    rows = [(k, i, draw.uniform(10, 20)) for k, n in (("a", 30), ("b", 14), ("c", 15), ("d", 1)) for i in range(n)]
    rows += [("up", i, float(i)) for i in range(20)]
    d = spark.createDataFrame(rows, "instrument string, d int, close double").withColumn("date", F.date_add(F.lit("2024-01-25").cast("date"), F.col("d")))
    got = {(r.instrument, r.date): r.rsi for r in scans.rsi_all(d, unit="week").collect()}
    assert len(got) == len(rows) and sum(v is not None for v in got.values()) == (30 - 14) + 0 + 1 + (20 - 14)
    for r in rolling.rsi(d).collect():
        assert got[r.instrument, r.date] == (None if r.rsi is None else pytest.approx(r.rsi, rel=1e-12))
    assert got["up", max(x for k, x in got if k == "up")] == 100


def test_ranks_agree_with_windows_on_ties_across_partitions(spark, hot):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for value in ("x", "p"):
            ranked = scans.value_ranks(hot, ["k"], value)
            cells = [F.col(c) for c in ("below", "equal", "n")]
            got = ranked.select("i", scans.mid_rank_of(*cells).alias("m"), scans.average_rank_of(*cells).alias("a"))
            want = hot.select("i", rolling.mid_rank(F.col(value), ["k"]).alias("m"), rolling.average_rank(F.col(value), ["k"]).alias("a"))
            same(got, want)
        alone = scans.value_ranks(hot.limit(1).select(F.lit(3).alias("z")), [], "z").first()
        assert (alone["below"], alone["equal"], alone["n"]) == (0, 1, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
