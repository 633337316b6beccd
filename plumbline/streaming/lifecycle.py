"""Attempt lifecycles kept up to date from a stream of audit events.

An extension: the batch operators in ``operators.events`` answer the same questions from the
whole log. State holds one small row for each attempt; late and repeated events change nothing
that they shouldn't, as all totals are sets, minima or maxima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.events import CLOSING, STARTED


def attempt_states(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per attempt of an event stream (or table): whether it started, how it ended last, and its last sequence number."""
    closing = F.col("type").isin(*CLOSING)
    return events.groupBy(*keys, "attempt", "attempt_id").agg(
        F.max((F.col("type") == STARTED).cast("int")).alias("started"),
        F.max(F.when(closing, F.struct("seq", "type"))).alias("last_closing"),
        F.max("seq").alias("last_seq"),
    )


def event_rates(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows of event time; state of windows older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def keep_latest(states: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each batch's changed attempts under the batch's name, so that a repeated batch overwrites itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch:08d}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each attempt out of all written batches."""
    row = F.struct("last_seq", "started", "last_closing")
    got = rows.groupBy(*keys, "attempt", "attempt_id").agg(F.max_by(row, F.struct("last_seq", "batch")).alias("r"))
    return got.select(*keys, "attempt", "attempt_id", "r.started", F.col("r.last_closing.type").alias("last_closing"), "r.last_seq")
