"""Framing of an unbounded stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_frames(events: DataFrame, length: str = "64 hours", hop: str = "16 hours", late: str = "2 hours", value: str = "value", time: str = "ts", key: str = "event_type") -> DataFrame:
    """(track, begin, end, n, total, rms) of each frame of each key's events, as sliding event-time windows.

    Works on a stream and on a table alike. On a stream frames are emitted once the watermark, ``late`` behind the newest event,
    has passed their end, and state is dropped with them; events that come later still are left out. Null times and keys are left out.
    """
    good = events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    x = F.col(value)
    framed = good.groupBy(F.window(time, length, hop), F.col(key).alias("track")).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sqrt(F.avg(x * x)).alias("rms"))
    return framed.select("track", F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "n", "total", "rms")
