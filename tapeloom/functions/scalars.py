"""Scalar rules that many operators share; all take and return columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    p = 10.0**digits
    return F.floor(x * p + 0.5) / p


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def unit(x: Column, low: float, high: float) -> Column:
    """Clamp to low..high and scale to 0..1."""
    return (clamp(x, float(low), float(high)) - low) / (high - low)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def positive(x: Column) -> Column:
    """The value if it is above 0, else null: prices and volumes of 0 are missing."""
    return F.when(x > 0, x)


def zscore(x: Column, mean: Column, sd: Column, n: Column) -> Column:
    """0 with fewer than two values or without spread."""
    return F.when((n < 2) | (sd == 0) | sd.isNull(), 0.0).otherwise((x - mean) / sd)


def flow_group(category: Column, kind: Column, variant: str, foreign_codes: tuple = (), code: Column | None = None) -> Column:
    """Foreign, local or retail, by one of four classifiers; null rows are left out of the flow."""
    asing, low = kind == "Asing", F.lower(category)
    retail, foreign = low.contains("retail"), low.contains("foreign")
    if variant == "flow":
        return F.when(asing | foreign, "foreign").when(retail, "retail").otherwise("local")
    if variant == "range":
        return F.when(retail, "retail").when(asing, "foreign").otherwise("local")
    if variant == "mvp":
        listed = code.isin(*foreign_codes) if foreign_codes else F.lit(False)
        return F.when(asing | listed, "foreign").when(~retail, "local")
    if variant == "smart":
        return F.when(asing, "foreign").otherwise("local")
    raise ValueError(variant)
