"""Shared-folder helpers: lineage cuts and distributed row numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine, where neither the session nor its context names a folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It comes from ``spark.checkpoint.dir``, else from the context's checkpoint
    directory. Without either, a cluster is an error: a folder of each machine
    would lose tables.
    """
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_CHECKPOINTS
    if given.isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; computes it once, now."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Add a gapless 0-based row number in the order of ``order``.

    The rows are range-partitioned and sorted, so no task holds more than its
    range; only one count per partition reaches the driver. Include a hash of
    the row in ``order`` if one value of the leading column may be frequent.
    The result is checkpointed: numbers do not change on recomputation.
    """
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_at", at))
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    row = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition: bounded by the number of partitions
    return (
        ranged.withColumn("_part", part.cast("long"))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, row)
        .drop("_part", "_start", "_at")
    )


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that a job wrote to the shared folder, in whatever store it is."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def _at(spark: SparkSession, path: str):
    """(file system, path) of a place in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder; the parent of the new place is made, and what is there already is an error."""
    fs, where = _at(spark, old)
    target = _at(spark, new)[1]
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(where, target):
        raise OSError(f"cannot rename {old} to {new}")
