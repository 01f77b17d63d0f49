"""Time series by vessel: gaps, splits and training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta_hours(points: DataFrame, vessel: str, ts: str, order: str, most: float = 24.0) -> DataFrame:
    """Adds delta_hours since the vessel's previous point, 0 for the first, clipped to [0, most]."""
    w = Window.partitionBy(vessel).orderBy(ts, order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    hours = (at - F.lag(at).over(w)) / 3_600_000_000
    return points.withColumn("delta_hours", F.round(F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce(hours, F.lit(0.0)))), 6))


def _numbered(points: DataFrame, vessel: str, ts: str, order: str) -> DataFrame:
    """Adds _n, the points of the vessel, and _i, the point's place from 1 by time: ranks within an hour, behind the running
    count of the hours before, so that no task holds all points of a vessel."""
    rows = points.withColumn("_b", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 3_600_000_000))
    hours = rows.groupBy(F.col(vessel).alias("_v"), F.col("_b").alias("_h")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_v")
    hours = hours.withColumn("_n", F.sum("_c").over(w)).withColumn("_before", F.sum("_c").over(w.orderBy("_h")) - F.col("_c")).drop("_c")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(vessel, "_b").orderBy(ts, order)))
    rows = rows.join(hours, F.col(vessel).eqNullSafe(F.col("_v")) & F.col("_b").eqNullSafe(F.col("_h")))
    return rows.withColumn("_i", F.col("_before") + F.col("_r")).drop("_b", "_v", "_h", "_before", "_r")


def chronological_split(points: DataFrame, vessel: str, ts: str, order: str, ratio: float = 0.8, least: int = 10) -> DataFrame:
    """Adds part: the first int(n * ratio) points of a vessel train, the rest validate; vessels below `least` are dropped."""
    rows = _numbered(points, vessel, ts, order).where(F.col("_n") >= least)
    return rows.withColumn("part", F.when(F.col("_i") <= F.floor(F.col("_n") * ratio), "train").otherwise("validation")).drop("_n", "_i")


def sliding_windows(points: DataFrame, vessel: str, ts: str, order: str, value: str, length: int = 32) -> DataFrame:
    """(vessel, window_id, points, mean, past_mean, future_mean): full windows, half a length apart; past is the first 60 %."""
    step, past = length // 2, int(0.6 * length)
    rows = _numbered(points, vessel, ts, order).withColumn("_i", F.col("_i") - 1)
    last = F.floor((F.col("_n") - length) / step)
    ids = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_i") - length) / step) + 1), F.floor(F.col("_i") / step))
    rows = rows.where(F.col("_n") >= length).withColumn("_last", last).select(vessel, value, "_i", "_last", F.explode(ids).alias("window_id")).where("window_id <= _last")
    at = F.col("_i") - F.col("window_id") * step
    mean = lambda c: F.round(F.avg(c), 8)
    return rows.groupBy(vessel, F.col("window_id").cast("long").alias("window_id")).agg(F.count("*").alias("points"), mean(F.col(value)).alias("mean"), mean(F.when(at < past, F.col(value))).alias("past_mean"), mean(F.when(at >= past, F.col(value))).alias("future_mean"))
