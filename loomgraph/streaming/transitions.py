"""Status transitions as a stream (our extension): counts in tumbling windows with a watermark, and the latest status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, new_status, n) of a batch or streaming log (changed_at timestamp, new_status)."""
    rows = log.withWatermark("changed_at", late) if log.isStreaming else log
    return rows.groupBy(F.window("changed_at", width).alias("w"), "new_status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "new_status", "n")


def latest(log: DataFrame) -> DataFrame:
    """(item_id, status): the status of the last change."""
    return log.groupBy("item_id").agg(F.max_by("new_status", F.struct("changed_at", "id")).alias("status"))
