"""Windowed moments of an event stream: the batch statistics, kept up to date as events come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, time: str = "ts", group: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Count, mean and deviation of ``value`` per group and window; later events than ``late`` are left out."""
    by = events.withWatermark(time, late).groupBy(F.window(time, window), group)
    return by.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).select("window.start", "window.end", group, "n", "mean", "std")


def windowed_correlation(events: DataFrame, x: Column, y: Column, time: str = "ts", group: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Number of pairs, covariance and Pearson's r of ``x`` and ``y`` per group and window, of a stream or a table.

    The state of a group is its co-moments, which merge, so each batch adds partial sums made where its rows are. The
    watermark is the state's time to live: windows that ended ``late`` before the latest event are closed and freed, and
    rows for them are left out. Pairs with a null do not count; r is null for under two pairs or without variance.
    """
    pair = events.withColumn("_x", F.when(y.isNotNull(), x).cast("double")).withColumn("_y", F.when(x.isNotNull(), y).cast("double"))
    by = pair.withWatermark(time, late).groupBy(F.window(time, window), group)
    sums = by.agg(F.count("_x").alias("n"), F.covar_samp("_x", "_y").alias("covariance"), F.stddev_samp("_x").alias("_sx"), F.stddev_samp("_y").alias("_sy"))
    r = F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("covariance") / (F.col("_sx") * F.col("_sy")))))
    return sums.select("window.start", "window.end", group, "n", "covariance", r.alias("r"))
