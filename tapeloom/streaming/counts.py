"""What became of the trades of each micro-batch: accepted, repeated, rejected, late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

BEFORE, AFTER = "trades_in", "trades_kept"


def counted(trades: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """The accepted trades of a stream of normalised ones, without repeated and late ones, observed on the way.

    Both observations are part of the plan: they cost no pass of their own and
    count what the batch's tasks have seen.
    """
    seen = trades.observe(BEFORE, F.count("*").alias("rows"), F.count_if(F.col("reject").isNotNull()).alias("rejected"))
    kept = seen.where("reject IS NULL").drop("reject").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash_id"])
    return kept.observe(AFTER, F.count("*").alias("rows"))


class TradeCounts(StreamingQueryListener):
    """Keeps, for each batch of queries on :func:`counted` trades, a dict of batch, accepted, repeated, rejected and late."""

    def __init__(self) -> None:
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if BEFORE not in p.observedMetrics:
            return
        rows, rejected = p.observedMetrics[BEFORE].rows, p.observedMetrics[BEFORE].rejected
        accepted = p.observedMetrics[AFTER].rows if AFTER in p.observedMetrics else 0
        if rows:  # a batch without data only moves the watermark
            late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators if o.operatorName.startswith("dedupe"))
            self.batches.append({"batch": p.batchId, "accepted": accepted, "repeated": rows - rejected - accepted - late, "rejected": rejected, "late": late})

    def table(self, spark: SparkSession) -> DataFrame:
        """The counts so far, one row for each batch."""
        return spark.createDataFrame([tuple(b.values()) for b in self.batches], "batch long, accepted long, repeated long, rejected long, late long")
