"""Tracks of a stream of signals: an addition, for data that keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_track(events: DataFrame, binsize: int, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, sum and maximum of (chrom, pos, value) per bin and window of event time; what
    is later than the watermark doesn't count any more. For append or update mode."""
    rows = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late).where("value > 0")
    keys = [F.window("at", window).alias("w"), "chrom", F.floor(F.col("pos") / binsize).cast("long").alias("bin")]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("max"))
    return found.select(F.col("w.start").alias("start"), "chrom", "bin", "n", "total", "max")
