"""Detectors over an unbounded stream of micro-operations.

The library's checks read complete histories; a stream allows those anomalies that need no later
correction: a read of an element whose append has failed, and an element that a read holds twice. State is
bounded by a watermark on the event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aborted_reads(mops: DataFrame, time: str = "time", delay: str = "10 minutes") -> DataFrame:
    """Committed reads of elements that an aborted transaction appended within ``delay`` (A1 over a stream).

    ``mops``: index, type, f, k, v, vs and an event-time column; an inner stream-stream join on (k, v)
    within the watermark.
    """
    rows = mops.withWatermark(time, delay)
    reads = rows.filter("type = 'ok' and f = 'r' and size(vs) > 0").select(F.col("index"), "k", F.explode("vs").alias("v"), F.col(time).alias("read_at"))
    failed = rows.filter("type = 'fail' and f = 'append'").select(F.col("index").alias("writer"), F.col("k").alias("wk"), F.col("v").alias("wv"), F.col(time).alias("failed_at"))
    near = F.expr(f"read_at >= failed_at - interval {delay} and read_at <= failed_at + interval {delay}")
    return reads.join(failed, (F.col("k") == F.col("wk")) & (F.col("v") == F.col("wv")) & near).select("index", "k", "v", "writer")


def repeated_elements(mops: DataFrame) -> DataFrame:
    """Reads with an element more than once (A8 over a stream); keeps no state."""
    bad = mops.filter("f = 'r' and type in ('ok', 'info') and vs is not null").filter(F.size("vs") != F.size(F.array_distinct("vs")))
    return bad.select("index", "k", (F.size("vs") - F.size(F.array_distinct("vs"))).alias("extra"))


def outcome_rates(mops: DataFrame, time: str = "time", window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Operations by outcome and window: whether a workload still commits."""
    return mops.withWatermark(time, delay).groupBy(F.window(time, window), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")
