"""Events to a dense panel of cells and time buckets, with features that only
look back.

One shuffle aggregates events to (cell, bucket) with a map-side combine; the
dense table repeats a calendar for every cell without a join between them; all
windows share one partitioning and order.  The panel's size is cells times
buckets, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.config import Features, Grid
from tesseral.functions.grid import bucket_start, cell_key, energy, grid_floor

PANEL_COLUMNS = (
    "cell_id", "week", "lat_grid", "lon_grid", "y_lag1", "mag_max_lag1", "mag_min_lag1",
    "mag_max_roll4", "count_roll12", "energy_roll8", "weeks_since_m45", "y",
)


def bin_events(events: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Add lat_grid, lon_grid, cell_id, energy and week; events without a place go."""
    return (
        events.na.drop(subset=["latitude", "longitude", "time"])
        .withColumn("lat_grid", grid_floor(F.col("latitude"), grid.lat_min, grid.size))
        .withColumn("lon_grid", grid_floor(F.col("longitude"), grid.lon_min, grid.size))
        .withColumn("cell_id", cell_key(F.col("lat_grid"), F.col("lon_grid")))
        .withColumn("energy", energy(F.col("mag")))
        .withColumn("week", bucket_start(F.col("time"), grid.unit))
    )


def aggregate_cells(binned: DataFrame) -> DataFrame:
    """Count, extreme magnitudes and energy of every cell and bucket with events."""
    return binned.groupBy("cell_id", "lat_grid", "lon_grid", "week").agg(
        F.count("mag").alias("y"), F.max("mag").alias("mag_max"), F.min("mag").alias("mag_min"), F.sum("energy").alias("energy_sum")
    )


def dense_base(sparse: DataFrame, unit: str = "week") -> DataFrame:
    """Every cell with every bucket from the first to the last; absent ones are 0."""
    cells = sparse.select("cell_id", "lat_grid", "lon_grid").distinct()
    span = sparse.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    calendar = F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {unit}"))).alias("week")
    grid = cells.crossJoin(F.broadcast(span)).select("cell_id", "lat_grid", "lon_grid", calendar)
    values = sparse.select("cell_id", "week", "y", "mag_max", "mag_min", "energy_sum")
    return grid.join(values, ["cell_id", "week"], "left").na.fill({"y": 0, "mag_max": 0.0, "mag_min": 0.0, "energy_sum": 0.0})


def add_features(base: DataFrame, features: Features = Features()) -> DataFrame:
    """Lags, rolling values and time since a major event, each of rows before its own."""
    w = Window.partitionBy("cell_id").orderBy("week")
    back = lambda n: w.rowsBetween(-n, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    major = F.max(F.when(F.col("mag_max") >= features.major, F.col("rn"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        base.withColumn("rn", F.row_number().over(w))
        .withColumn("y_lag1", zero(F.lag("y").over(w).cast("double")))
        .withColumn("mag_max_lag1", zero(F.lag("mag_max").over(w)))
        .withColumn("mag_min_lag1", zero(F.lag("mag_min").over(w)))
        .withColumn("mag_max_roll4", zero(F.max("mag_max").over(back(features.max_width))))
        .withColumn("count_roll12", zero(F.sum("y").over(back(features.count_width)).cast("double")))
        .withColumn("energy_roll8", zero(F.sum("energy_sum").over(back(features.energy_width))))
        .withColumn("weeks_since_m45", F.coalesce((F.col("rn") - 1 - major).cast("double"), F.lit(features.never)))
    )


def build_panel(events: DataFrame, grid: Grid = Grid(), features: Features = Features()) -> DataFrame:
    """The panel without each cell's warm-up buckets."""
    full = add_features(dense_base(aggregate_cells(bin_events(events, grid)), grid.unit), features)
    return full.where(F.col("rn") > features.warm_up).select(*PANEL_COLUMNS)
