"""Extension: damages from a stream of hazard observations, by windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.damage import damages


def peak_levels(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, row, col, value: highest value of each cell in each window; events (ts, row, col, value) later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "row", "col").agg(F.max("value").alias("value"))


def asset_damages(levels: DataFrame, assets: DataFrame, dense: DataFrame) -> DataFrame:
    """window, object_id, inun_depth, damage for static assets (object_id, row, col, ground_flht, fn, max) and streamed levels."""
    rows = levels.join(assets, ["row", "col"]).withColumn("inun_depth", F.col("value") - F.col("ground_flht")).withColumn("red_fact", F.lit(1.0))
    return damages(rows, dense).select("window", "object_id", "inun_depth", "damage")
