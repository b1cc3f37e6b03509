"""The canonical entities, read from the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instrument, ts, seq, price, qty): one trade a row, of every event."""
    e = read(spark, sf_dir, "events")
    qty = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select(F.col("event_type").alias("instrument"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), qty.alias("qty"))


def broker_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, broker, side, value, lots): a trading day is a month of shipping."""
    li, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = li.join(part, li.l_partkey == part.p_partkey)
    return rows.select(
        F.trunc("l_shipdate", "month").alias("date"),
        F.col("p_brand").alias("ticker"),
        F.col("l_suppkey").alias("broker"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
        F.col("l_extendedprice").cast(MONEY).alias("value"),
        F.col("l_quantity").cast("bigint").alias("lots"),
    )


#: Category and type of a broker by its region: fixed sample values that make the classifiers disagree.
CATEGORIES = {0: ("Retail", "Lokal"), 1: ("Foreign Fund", "Asing"), 2: ("Local Fund", "Lokal"), 3: ("Retail Online", "Asing"), 4: ("Foreign Bank", "Lokal")}


def brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(broker, category, type)."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for r, v in CATEGORIES.items() for x in (r, v[k])]), F.col("n_regionkey"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("broker"), pick(0).alias("category"), pick(1).alias("type"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector, status) of every part."""
    p = read(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("T"), F.col("p_partkey")).alias("ticker"), F.col("p_type").alias("sector"), F.when(F.col("p_size") <= 40, "ACTIVE").otherwise("SUSPENDED").alias("status"), "p_name")
