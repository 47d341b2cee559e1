"""Scans and sinks of catalogues and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.config import END_DATE, MIN_MAGNITUDE, START_DATE, Grid
from tesseral.operators.ingest import CATALOGUE_COLUMNS, naive_utc, upsert

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CATALOGUE_COLUMNS])


def request_params(grid: Grid = Grid(), start: str = START_DATE, end: str = END_DATE, min_magnitude: float = MIN_MAGNITUDE) -> dict[str, str]:
    """Query parameters of an FDSN event service for the study's box; service.fetch_events() sends them.
    Fixed values: the parameters' names."""
    return {
        "format": "csv", "starttime": start, "endtime": end, "minmagnitude": str(min_magnitude), "minlatitude": str(grid.lat_min),
        "maxlatitude": str(grid.lat_max), "minlongitude": str(grid.lon_min), "maxlongitude": str(grid.lon_max), "orderby": "time-asc",
    }


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw events from CSV with a header, or Parquet, as text columns."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True).select(*CATALOGUE_COLUMNS)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one where nothing is stored yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Overwrite a table; CSV gets a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


#: The result tables of a study.
RESULTS = (
    "completeness", "cell_dispersion", "alpha_audit", "identifiability", "overdispersion_test", "calibration", "tail_evaluation",
    "spatial_diagnostics", "walk_forward", "comparison", "test_predictions", "calibration_predictions",
)


def write_results(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> list[str]:
    """Store any of the RESULTS as folder/name; returns what was written."""
    unknown = sorted(set(tables) - set(RESULTS))
    if unknown:
        raise ValueError(f"no such results: {unknown}")
    for name, table in tables.items():
        write_table(table, f"{folder.rstrip('/')}/{name}", form)
    return list(tables)


#: The panel's stored columns and their types.
PANEL_SCHEMA = (
    "cell_id string, week timestamp_ntz, lat_grid double, lon_grid double, y_lag1 double, mag_max_lag1 double, mag_min_lag1 double, "
    "mag_max_roll4 double, count_roll12 double, energy_roll8 double, weeks_since_m45 double, y long"
)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel with its types, from CSV with a header or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(PANEL_SCHEMA).csv(path, header=True, enforceSchema=False)
    return spark.read.schema(PANEL_SCHEMA).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw events with times of mixed forms as UTC without a zone; rows without a time, place or magnitude go."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    rows = read_raw(spark, path).select(naive_utc(F.col("time").cast("string")).alias("time"), *map(number, ("latitude", "longitude", "depth", "mag")), "place")
    return rows.na.drop(subset=["time", "latitude", "longitude", "mag"])


def upsert_table(new: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """Rows of `new` replace the stored ones of their keys; what the next
    write_table() to another path should store.  A table can't be overwritten
    while it is read."""
    return upsert(read_optional(new.sparkSession, path, schema), new, key)
