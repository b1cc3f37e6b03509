"""Set, join and top-k shapes that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of every key; one partial aggregate, no self-join."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def as_of(left: DataFrame, right: DataFrame, key: str, date: str, strict: bool = False) -> DataFrame:
    """Left rows with the newest right row of the key up to (``strict``: before) their date.

    Both sides are merged in one ordered pass per key: no range join.
    Right columns must not clash with the left ones; left rows without an
    earlier right row get nulls.
    """
    columns = [c for c in right.columns if c not in (key, date)]
    l = left.select(key, date, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_v"), F.lit(0 if strict else 1).alias("_side"))
    r = right.select(key, date, F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*columns).alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    w = W.partitionBy(key).orderBy(date, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.where("_l IS NOT NULL").select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in columns])


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top(rows, key, order, 1)


def search(rows: DataFrame, text: str, column: str, limit: int = 500, **equal) -> DataFrame:
    """Rows whose column contains the text (any case) and whose other columns equal the given values; limit 1..2000."""
    clean = text.replace("%", "").replace("_", "")
    out = rows.where(F.lower(column).contains(clean.lower())) if clean else rows
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.orderBy(column).limit(max(1, min(2000, limit)))


def any_term(column: str, terms: str) -> Column:
    """True if the column contains one of the comma- or space-separated terms."""
    parts = [t for t in terms.upper().replace(",", " ").split() if t]
    return F.exists(F.array(*map(F.lit, parts)), lambda t: F.upper(F.col(column)).contains(t)) if parts else F.lit(True)


def merged(sources: list[tuple[str, DataFrame]], key: list[str], columns: list[str], prefer: dict[str, list[str]] | None = None) -> DataFrame:
    """Full outer merge by key: for each column the first source that has a value; ``source`` names the first that has the row.

    ``prefer`` gives columns another order of sources; sources it does not name
    are not asked for that column.
    """
    out = None
    for name, df in sources:
        mine = df.select(*key, *[(F.col(c) if c in df.columns else F.lit(None)).alias(f"{name}_{c}") for c in columns], F.lit(name).alias(f"{name}_has"))
        out = mine if out is None else out.join(mine, key, "full")
    order = prefer or {}
    pick = lambda c: F.coalesce(*[F.col(f"{n}_{c}") for n in order.get(c, [n for n, _ in sources])])
    return out.select(*key, *[pick(c).alias(c) for c in columns], pick("has").alias("source"))


def missing_dates(rows: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """Calendar dates that a key has no row for."""
    keys = rows.select(key).distinct()
    grid = keys.crossJoin(calendar.select("date"))  # expected key-dates: the answer's own grid; Spark broadcasts a small side
    return grid.join(rows.select(key, "date").distinct(), [key, "date"], "left_anti")


def plain_text(html: str) -> Column:
    """HTML without scripts, styles, tags and runs of white space."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "))
