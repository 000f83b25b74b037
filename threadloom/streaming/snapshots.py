"""Streaming forms of the cumulative attitude snapshot and of daily volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_attitudes(stream: DataFrame) -> DataFrame:
    """Each user's mean attitude so far, as an updating aggregate (update or complete mode)."""
    return stream.where("user_id is not null and attitude_score is not null").groupBy("user_id").agg(F.avg("attitude_score").alias("attitude"), F.max("day").alias("day"), F.count(F.lit(1)).alias("n"))


def window_volume(stream: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Posts in each window of event time; state of windows older than the watermark is dropped."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zoned type
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("volume")).select(F.col("w.start").alias("start"), "volume")
