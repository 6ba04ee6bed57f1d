"""Per-signal transforms, as window expressions partitioned by signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    """A signal's points in order; equal times by value."""
    return Window.partitionBy("signal_id").orderBy("timestamp", "value")


def whole() -> WindowSpec:
    """A signal's points together."""
    return Window.partitionBy("signal_id")


def difference(signals: DataFrame) -> DataFrame:
    """First differences, at the later point's time.  ValueError if a signal has one point."""
    if not signals.groupBy("signal_id").count().where("count < 2").isEmpty():
        raise ValueError("a signal has fewer than two points")
    before = signals.withColumn("before", F.lag("value").over(by_time())).withColumn("k", F.row_number().over(by_time()))
    return before.where("k > 1").select("signal_id", "timestamp", (F.col("value") - F.col("before")).alias("value"))


def detrend_linear(signals: DataFrame) -> DataFrame:
    """Residuals of each signal's least-squares line in time; of its mean where time doesn't vary."""
    centred = signals.withColumn("t", F.col("timestamp") - F.avg("timestamp").over(whole())).withColumn("mean", F.avg("value").over(whole()))
    sums = centred.withColumn("sxy", F.sum(F.col("t") * (F.col("value") - F.col("mean"))).over(whole())).withColumn("sxx", F.sum(F.col("t") * F.col("t")).over(whole()))
    slope = F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0))
    return sums.select("signal_id", "timestamp", (F.col("value") - F.col("mean") - slope * F.col("t")).alias("value"))


def normalise(signals: DataFrame) -> DataFrame:
    """(value - mean) / sample deviation of each signal; NaN where that deviation is 0 or undefined."""
    spread = F.stddev_samp("value").over(whole())
    scaled = F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(whole()), spread), F.lit(float("nan")))
    return signals.select("signal_id", "timestamp", scaled.alias("value"))


def reindex(signals: DataFrame) -> DataFrame:
    """Times replaced by 0, 1, 2, ... in each signal."""
    return signals.select("signal_id", (F.row_number().over(by_time()) - 1).cast("double").alias("timestamp"), "value")
