"""Departures of stops as a stream. An addition: batch has no counterpart of late data.

Tumbling windows with a watermark give the streaming version of departure rates; sessions rebuild trips from gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(stream: DataFrame, width: str = "2 hours", late: str = "1 hour", time: str = "ts", stop: str = "stop") -> DataFrame:
    """(start, stop, departures) of each window, final once the watermark has passed."""
    own = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, width), stop).agg(F.count(F.lit(1)).alias("departures")).select(F.col("window.start").alias("start"), stop, "departures")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", trip: str = "trip") -> DataFrame:
    """(trip, start, end, visits): visits of a vehicle without a longer gap."""
    own = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.session_window(time, gap), trip).agg(F.count(F.lit(1)).alias("visits")).select(trip, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "visits")
