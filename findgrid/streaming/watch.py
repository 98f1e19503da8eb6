"""Continuous monitoring: new findings since the last batch, and counts of events by window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Watch:
    """Batches of fingerprints compared with those of the batch before. The first batch is the base line and reports nothing; a
    finding that went and came back is reported again. State: one Parquet folder for each batch number, so a batch that is
    run again after a failure finds the same state before it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _state(self, batch: int) -> DataFrame | None:
        try:
            return self.spark.read.schema("fingerprint string").parquet(f"{self.root}/state/b{batch}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def apply(self, fingerprints: DataFrame, batch: int) -> DataFrame:
        """New fingerprints of the batch; its state and alerts are written."""
        now = fingerprints.select("fingerprint").distinct()
        now.write.mode("overwrite").parquet(f"{self.root}/state/b{batch}")
        now = self._state(batch)
        before = self._state(batch - 1)
        fresh = now.limit(0) if before is None or before.isEmpty() else now.join(before, "fingerprint", "left_anti")
        fresh.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.root}/alerts/b{batch}")
        return self.spark.read.schema("fingerprint string, batch long").parquet(f"{self.root}/alerts/b{batch}")

    def start(self, findings: DataFrame, checkpoint: str, **trigger):
        """Stream of findings with a fingerprint column; each micro-batch is a full scan."""
        return findings.writeStream.foreachBatch(lambda df, n: self.apply(df, n) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type of a batch or stream of events (ts, event_type, value); on a stream, windows close
    `late` behind the newest event. An addition of ours."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
