from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fd_stream_counts(stream: DataFrame, time: str, left: str, right: str, late: str, window: str = "1 day") -> DataFrame:
    """window_start, left, right, n: value counts per event-time window, for FD checks on what recently arrived.

    Rows later than `late` are left out by the watermark, so it must be named: what comes months late needs months. State
    is one counter a window and value pair, kept for that long.
    """
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, window), left, right).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), left, right, "n")
    )
