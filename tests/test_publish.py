"""Versions, the newest day, month files, retention and covered sources on real folders."""

import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import publish
from tapeloom.storage import remove, renamed

SUMMARY = "ticker string, source string, delta_pct double, net_delta long, vol long, open double"
OLD = [("A", "FULL", 1.5, 10, 100, 7.0), ("B", "FULL", 0.0, 0, 50, None), ("C", "ZSCORE", 9.0, 9, 9, 9.0)]


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*.parquet")}


def test_versions_switch_at_their_manifest(spark, tmp_path):
    place = publish.Publication(spark, f"file://{tmp_path}/p")
    assert place.manifest() is None and place.read() is None
    one = spark.range(3)
    place.publish(one)
    # a writer that dies before its manifest leaves the old version current
    one.write.parquet(f"file://{tmp_path}/p/versions/00000002-dead")
    assert place.read().count() == 3 and place.manifest()["rows"] == 3
    place.publish(spark.range(5), full=2)
    assert place.read().count() == 5 and place.manifest() == place.manifest() | {"number": 2, "full": 2}
    with pytest.raises(OSError):  # a second writer of the same number
        renamed(spark, f"file://{tmp_path}/p/versions", f"file://{tmp_path}/p/manifests/00000002")
    for n in range(3):
        place.publish(spark.range(n))
    place.drop_old(2)
    assert place.manifests() == [4, 5] and len(list((tmp_path / "p" / "versions").iterdir())) == 2 and place.read().count() == 2


def test_guard_keeps_carries_and_publishes(spark, tmp_path):
    old = spark.createDataFrame(OLD, SUMMARY)
    scores = [("A", "ZSCORE", 0.0, None, 0, None), ("B", "ZSCORE", 0.5, 3, 0, 2.0), ("C", "ZSCORE", 0.0, 0, 0, None), ("D", "ZSCORE", 0.0, 0, 0, None)]
    want = {"A": ("FULL_CARRIED", 1.5, 10, 100, 7.0), "B": ("FULL_CARRIED", 0.5, 3, 50, 2.0), "C": ("ZSCORE", 0.0, 0, 0, None), "D": ("ZSCORE", 0.0, 0, 0, None)}
    for rows, market_open, done in ((scores[:3], False, "kept"), (scores, False, "carried"), (scores, True, "published"), (OLD, False, "published")):
        place = publish.Publication(spark, f"file://{tmp_path}/{done}{market_open}{len(rows)}")
        assert publish.publish_summary(place, old, "ticker", False) == "published"  # nothing before it
        assert publish.publish_summary(place, spark.createDataFrame(rows, SUMMARY), "ticker", market_open) == done
        got = {r.ticker: tuple(r)[1:] for r in place.read().collect()}
        assert got == ({r[0]: r[1:] for r in OLD} if done == "kept" else want if done == "carried" else {r[0]: r[1:] for r in rows})
        assert place.manifest()["number"] == (1 if done == "kept" else 2)


def test_newest_day_reads_one_partition_and_looks_a_week_back(spark, tmp_path):
    day = datetime.date.fromisoformat
    rows = [("2024-01-11", 1), ("2024-01-12", 2), ("2024-01-13", 3), ("2024-01-19", 4)]  # the 13th is a Saturday
    folder = f"file://{tmp_path}/t"
    spark.createDataFrame(rows, "date string, x int").write.partitionBy("date").parquet(folder)
    found = publish.read_newest(spark, folder, day("2024-01-13"))  # a gap of one day
    assert [(r.x, str(r.date)) for r in found.collect()] == [(2, "2024-01-12")] and len(found.inputFiles()) == 1
    assert publish.newest_day(spark, folder, day("2024-01-15")) == day("2024-01-12")  # over a weekend
    assert publish.newest_day(spark, folder, day("2024-01-13"), holidays=[day("2024-01-12")]) == day("2024-01-11")
    assert publish.newest_day(spark, folder, day("2024-01-27")) is None and publish.read_newest(spark, folder, day("2024-01-27")) is None  # a gap of eight
    assert publish.newest_day(spark, f"{folder}/none", day("2024-01-27")) is None


def test_months_merge_by_date_and_others_keep_their_files(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/m", "ticker string, date date, x int"
    day = datetime.date.fromisoformat
    first = [(t, day(d), 1) for t in "AB" for d in ("2024-01-30", "2024-02-01", "2024-02-02", "2024-03-05")]
    assert publish.merge_months(spark.createDataFrame(first, schema), folder, ["ticker"]) == ["2024-01", "2024-02", "2024-03"]
    before = files(tmp_path / "m")
    new = [("A", day("2024-02-02"), 2), ("A", day("2024-02-03"), 2), ("C", day("2024-04-01"), 2)]
    assert publish.merge_months(spark.createDataFrame(new, schema), folder, ["ticker"]) == ["2024-02", "2024-04"]
    want = {(t, d): x for t, d, x in first} | {(t, d): x for t, d, x in new}
    read = lambda: {(r.ticker, r.date): r.x for r in spark.read.parquet(folder).collect()}
    assert read() == want and spark.read.parquet(folder).count() == len(want)
    after = files(tmp_path / "m")
    kept = {k: v for k, v in before.items() if "2024-02" not in k}
    assert {k: v for k, v in after.items() if "2024-02" not in k and "2024-04" not in k} == kept
    # a job that fails while it writes changes nothing
    bad = spark.createDataFrame(new, schema).withColumn("x", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        publish.merge_months(bad, folder, ["ticker"])
    assert read() == want
    # a swap that broke between its two renames is mended by the next call
    renamed(spark, f"{folder}/month=2024-02", f"{folder}/_gone-x/month=2024-02")
    spark.range(1).write.parquet(f"{folder}/_stage-x")
    publish.merge_months(spark.createDataFrame(new[2:], schema), folder, ["ticker"])
    assert read() == want and not [p for p in (tmp_path / "m").iterdir() if p.name.startswith("_gone") or p.name.startswith("_stage")]
    assert publish.merge_months(spark.createDataFrame([], schema), folder, ["ticker"]) == []


def test_retention_drops_partitions_by_limits_of_their_own(spark, tmp_path):
    raw, candles = f"file://{tmp_path}/raw", f"file://{tmp_path}/candles"
    rows = spark.range(40).select(F.date_sub(F.lit("2024-02-10").cast("date"), F.col("id").cast("int")).alias("date"), "id")
    for folder in (raw, candles):
        rows.repartition("date").write.partitionBy("date").parquet(folder)
    today = datetime.date(2024, 2, 10)
    assert publish.retain(spark, {raw: 7, candles: 30, f"{raw}/none": 1}, today) == {raw: 32, candles: 9, f"{raw}/none": 0}
    assert spark.read.parquet(raw).agg(F.min("date"), F.count("*")).first() == (datetime.date(2024, 2, 3), 8)
    assert publish.drop_before(spark, raw, today, 7) == [] and spark.read.parquet(candles).count() == 31
    remove(spark, raw)


def test_covered_sources_and_their_cutoff(spark):
    at = lambda t: F.to_timestamp(F.lit(t))
    rows = [("A", "08:49", 1), ("A", "03:00", 2), ("B", "08:50", 3), ("B", "02:00", 4), ("C", "07:00", 5)]
    make = lambda rows: spark.createDataFrame([(k, f"2024-01-10 {c}:00", x) for k, c, x in rows], "k string, t string, x int").select("k", F.to_timestamp("t").alias("ts"), F.to_date("t").alias("date"), "x")
    first, second = make(rows), make([("A", "02:00", 10), ("B", "02:00", 20), ("D", "02:00", 30)])
    got = lambda now: sorted((r.k, r.x, r.origin) for r in publish.covered(first, second, ["k", "date"], "ts", publish.end_cutoff(F.col("date"), at(now))).collect())
    late = [("A", 10, "second"), ("B", 3, "first"), ("B", 4, "first"), ("D", 30, "second")]  # C is not covered and nowhere else
    assert got("2024-01-12 05:00:00") == late and got("2024-01-10 12:00:00") == [("A", 10, "second"), ("B", 20, "second"), ("D", 30, "second")]
    assert [x for x in got("2024-01-10 07:10:00")] == [("A", 1, "first"), ("A", 2, "first"), ("B", 3, "first"), ("B", 4, "first"), ("C", 5, "first"), ("D", 30, "second")]


def test_feed_turns_back_when_the_window_is_empty(spark):
    a = spark.createDataFrame([("a", i, f"2024-01-{i:02d} 00:00:00") for i in range(1, 11)], "kind string, id int, m string").select("kind", "id", F.to_timestamp("m").alias("moment"))
    b = a.select(F.lit("b").alias("kind"), "id", "moment")
    at = lambda t: F.to_timestamp(F.lit(t))
    rows = lambda df: [(r.kind, r.id, r.backward) for r in df.orderBy("moment", "kind").collect()]
    assert rows(publish.feed([a, b], at("2024-01-08"), None, 3)) == [("a", 8, False), ("b", 8, False), ("a", 9, False)]
    assert rows(publish.feed([a, b], at("2024-02-08"), None, 3)) == [("a", 9, True), ("a", 10, True), ("b", 10, True)]
    assert rows(publish.feed([a, b], at("2024-02-08"), None, 3, explicit=True)) == []
    plan = publish.feed([a, b], at("2024-01-08"), None, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan  # no global sort
