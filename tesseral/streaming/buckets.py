"""Bucket counts of an event stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.config import Grid
from tesseral.functions.grid import cell_key, energy, grid_floor


def stream_counts(events: DataFrame, grid: Grid = Grid(), late: str = "1 day") -> DataFrame:
    """(cell_id, week, y, mag_max, mag_min, energy_sum) of a stream of events.

    Weeks start on Mondays: windows of seven days from the epoch would start on
    Thursdays, so they are moved by four days.
    """
    width, offset = ("7 days", "4 days") if grid.unit == "week" else (f"1 {grid.unit}", "0 seconds")
    placed = events.where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn(
        "cell_id", cell_key(grid_floor(F.col("latitude"), grid.lat_min, grid.size), grid_floor(F.col("longitude"), grid.lon_min, grid.size))
    )
    counted = placed.withWatermark("time", late).groupBy("cell_id", F.window("time", width, width, offset).alias("w"))
    out = counted.agg(F.count("mag").alias("y"), F.max("mag").alias("mag_max"), F.min("mag").alias("mag_min"), F.sum(energy(F.col("mag"))).alias("energy_sum"))
    return out.select("cell_id", F.col("w.start").alias("week"), "y", "mag_max", "mag_min", "energy_sum")
