"""Ordered scans in two levels, for keys whose whole history is too long to sort in one task.

A key's rows are divided into parts by a column that follows the order (a month
of the date, say). Parts are scanned on their own; one row for each part
carries on what the parts before it leave; the carry is joined back. No task
sees more than one part's rows, or one row for each part of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.scalars import ratio
from tapeloom.storage import cut

PART = "_part"
#: Distinct values whose ranks are broadcast at most; more are joined by shuffle.
BROADCAST_VALUES = 1_000_000


def _with_carry(rows: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``_carry`` of their part; null keys are keys like others."""
    keys = [*by, PART]
    carry = carry.select("_carry", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(carry, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def running_sum(rows: DataFrame, by: list[str], order: list[str], part: Column, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to the current one (before it, if not ``inclusive``); nulls count as 0."""
    rows = rows.withColumn(PART, part).withColumn("_x", value)
    local = W.partitionBy(*by, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn("_own", F.sum("_x").over(local))
    totals = rows.groupBy(*by, PART).agg(F.sum("_x").alias("_total"))
    earlier = W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.sum("_total").over(earlier))  # one row for each part of a key
    zero = F.lit(0)
    out = _with_carry(rows, carry, by).withColumn(name, F.coalesce("_carry", zero) + F.coalesce("_own", zero))
    return out.drop(PART, "_x", "_own", "_carry")


def last_known(rows: DataFrame, by: list[str], order: list[str], part: Column, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """The last ``value`` that is not null among the rows of a key up to the current one (before it, if not ``inclusive``)."""
    rows = rows.withColumn(PART, part).withColumn("_x", value)
    local = W.partitionBy(*by, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn("_own", F.last("_x", ignorenulls=True).over(local))
    newest = F.max_by("_x", F.when(F.col("_x").isNotNull(), F.struct(*order)))
    parts = rows.groupBy(*by, PART).agg(newest.alias("_newest"))
    earlier = W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    carry = parts.withColumn("_carry", F.last("_newest", ignorenulls=True).over(earlier))
    return _with_carry(rows, carry, by).withColumn(name, F.coalesce("_own", "_carry")).drop(PART, "_x", "_own", "_carry")


def as_of_parts(left: DataFrame, right: DataFrame, key: str, date: str, unit: str = "month", strict: bool = False) -> DataFrame:
    """Left rows with the newest right row of the key up to (``strict``: before) their date; as :func:`relational.as_of`, in two levels.

    Right columns must not clash with the left ones; left rows without an
    earlier right row get nulls. Parts are the ``unit`` of the date.
    """
    columns = [c for c in right.columns if c not in (key, date)]
    kind = right.select(F.struct(*columns)).schema[0].dataType
    l = left.select(key, date, F.struct(*left.columns).alias("_l"), F.lit(None).cast(kind).alias("_v"), F.lit(0 if strict else 1).alias("_side"))
    r = right.select(key, date, F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*columns).alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    both = last_known(l.unionByName(r), [key], [date, "_side"], F.date_trunc(unit, date), F.col("_v"), "_known")
    return both.where("_l IS NOT NULL").select("_l.*", *[F.col(f"_known.{c}").alias(c) for c in columns])


def composed(a, b):
    """The maps x -> a x + b composed from the first to each, as two arrays: composition is associative, so it doubles its reach each step."""
    import numpy as np

    a, b, reach = np.array(a, float), np.array(b, float), 1
    while reach < len(a):
        b[reach:], a[reach:] = a[reach:] * b[:-reach] + b[reach:], a[reach:] * a[:-reach]
        reach *= 2
    return a, b


def _composed_by(rows: DataFrame, groups: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Columns a_<name> and b_<name> replaced by those of the maps composed within the group."""

    def scan(table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in order])
        for n in names:
            for c, x in zip((f"a_{n}", f"b_{n}"), composed(table[f"a_{n}"].to_numpy(), table[f"b_{n}"].to_numpy()), strict=True):
                table = table.set_column(table.schema.get_field_index(c), c, pa.array(x))
        return table

    return rows.groupBy(*groups).applyInArrow(scan, rows.schema)


def affine_scan(rows: DataFrame, by: list[str], order: list[str], part: Column, maps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add columns x with x = a * (x of the row before) + b, and 0 before a key's first row; ``maps`` has (a, b) by name.

    a and b are numbers, never null. Orders must be unique within a key.
    """
    names = list(maps)
    one = {f"{k}_{n}": m[i].cast("double") for n, m in maps.items() for i, k in enumerate("ab")}
    cells = list(one)
    mapped = rows.withColumn(PART, part).withColumns(one)
    slim = mapped.select(*by, PART, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *cells, F.struct(*rows.columns).alias("_row"))
    local = _composed_by(slim, [*by, PART], [f"_o{i}" for i in range(len(order))], names)
    # the composed map of a part is that of its last row
    ends = local.groupBy(*by, PART).agg(F.max_by(F.struct(*cells), F.struct(*[f"_o{i}" for i in range(len(order))])).alias("_end")).select(*by, PART, "_end.*")
    ends = _composed_by(ends, by, [PART], names)
    earlier = W.partitionBy(*by).orderBy(PART)
    carry = ends.withColumn("_carry", F.lag(F.struct(*[f"b_{n}" for n in names])).over(earlier))  # applied to 0, a map gives its b
    out = _with_carry(local, carry.select(*by, PART, "_carry"), by)
    value = lambda n: F.col(f"a_{n}") * F.coalesce(F.col(f"_carry.b_{n}"), F.lit(0.0)) + F.col(f"b_{n}")
    return out.select("_row.*", *[value(n).alias(n) for n in names])


def rsi_all(d: DataFrame, period: int = 14, key: str = "instrument", price: str = "close", unit: str = "month") -> DataFrame:
    """Wilder's RSI of every row from the key's whole history up to it; null until there are ``period`` changes."""
    part = F.date_trunc(unit, "date")
    d = d.select(key, "date", F.col(price).cast("double").alias("_p"))
    d = last_known(d, [key], ["date"], part, F.col("_p"), "_before", inclusive=False).withColumn("_d", F.col("_p") - F.col("_before"))
    d = running_sum(d, [key], ["date"], part, F.col("_d").isNotNull().cast("int"), "_i")
    keeps = F.when(F.col("_i") <= period, 1.0).otherwise((period - 1) / period)  # the first changes add up to their average
    change = F.coalesce("_d", F.lit(0.0))
    maps = {"_up": (keeps, F.greatest(change, F.lit(0.0)) / period), "_down": (keeps, F.greatest(-change, F.lit(0.0)) / period)}
    d = affine_scan(d, [key], ["date"], part, maps)
    value = F.when(F.col("_down") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col("_up"), F.col("_down"))))
    return d.select(key, "date", F.when(F.col("_i") >= period, value).alias("rsi"))


def value_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with below, equal and n: rows of the group with a smaller value, with the same one, and with any; null where the value is.

    Values are counted first; distinct ones are range-partitioned, and counts
    before each partition's first value make ranks that agree across
    partitions. A value that very many rows share is one row here.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("equal"))
    ranged = cut(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))  # cut: the ranges must not move
    placed = running_sum(ranged, by, [value], F.col("_range"), F.col("equal"), "below", inclusive=False)
    totals = ranged.groupBy(*by).agg(F.sum("equal").alias("n"))
    keys = [*by, value]
    same = lambda of, cols: [F.col(c).eqNullSafe(F.col(f"{of}{i}")) for i, c in enumerate(cols)]
    totals = totals.select("n", *[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)])
    placed = placed.join(totals, same("_t", by) or F.lit(True)).select("below", "equal", "n", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(keys)])
    placed = cut(placed)
    near = F.broadcast if placed.count() <= BROADCAST_VALUES else (lambda x: x)
    return rows.join(near(placed), same("_p", keys), "left").drop(*[f"_p{i}" for i in range(len(keys))])


def mid_rank_of(below: Column, equal: Column, n: Column) -> Column:
    """(values below + half of the equal ones) / n; 0.5 alone."""
    return F.when(n <= 1, F.when(n.isNotNull(), 0.5)).otherwise((below + 0.5 * equal) / n)


def average_rank_of(below: Column, equal: Column, n: Column, fallback: float = 0.5) -> Column:
    """Average rank / (n - 1); 0.5 alone, ``fallback`` without a value."""
    return F.when(n.isNull(), fallback).when(n <= 1, 0.5).otherwise((below + (equal - 1) / 2) / (n - 1))
