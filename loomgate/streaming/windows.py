"""Measurements as a stream: windowed levels with late data, and timeouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.functions.text import plain


def windowed_levels(stream: DataFrame, width: str = "1 hour", late: str = "30 minutes", at: str = "measured_at") -> DataFrame:
    """Count, mean and extremes of good readings by tier, runner and window.

    Works on a stream or a batch.  Re-delivered measurements inside the
    watermark count once; readings later than ``late`` are dropped by the
    stream, as its watermark says.
    """
    rows = stream.filter(plain(F.col("status")) == "ok").withColumn("at", F.col(at).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["measurement_id"])
    else:
        rows = rows.dropDuplicates(["measurement_id"])
    v = F.col("wall_ms")
    good = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    grouped = good.groupBy(F.window("at", width).alias("w"), "tier", "runner_id")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean_ms"), F.min(v).alias("least_ms"), F.max(v).alias("most_ms")).select(
        F.col("w.start").alias("window_start"), "tier", "runner_id", "n", "mean_ms", "least_ms", "most_ms"
    )
