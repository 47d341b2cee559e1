"""Cleaning and validation of event catalogues, upserts, and small row tools."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.config import MIN_MAGNITUDE, Grid

# The columns of a catalogue, in its order.
CATALOGUE_COLUMNS = ("time", "latitude", "longitude", "depth", "mag", "place")


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The table itself, or ValueError naming what it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def or_empty(df: DataFrame, columns: tuple[str, ...], schema: str) -> DataFrame:
    """The table itself, or, with a warning, an empty one of the schema where it
    lacks any of the columns."""
    missing = [c for c in columns if c not in df.columns]
    if not missing:
        return df
    warnings.warn(f"skipped, missing columns: {missing}", stacklevel=2)
    return df.sparkSession.createDataFrame([], schema)


#: Forms of times besides those that a cast to a timestamp reads.
TIME_FORMS = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd-MM-yyyy HH:mm:ss")


def naive_utc(text: Column) -> Column:
    """Times in mixed forms as UTC without a zone: those with an offset are
    converted, those without one are UTC already; null where no form fits."""
    aware = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    forms = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMS]
    return F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & text.contains(":"), aware).otherwise(F.coalesce(text.try_cast("timestamp_ntz"), *forms))


def clean_catalogue(raw: DataFrame) -> DataFrame:
    """Typed events with place and magnitude, by time (a sort that plans without
    a use for it leave out).  Numbers that don't parse become null; a row without
    latitude, longitude, magnitude or time goes, one without depth stays.  A time
    that doesn't parse is an error."""
    rows = require_columns(raw, CATALOGUE_COLUMNS).select(*CATALOGUE_COLUMNS)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    typed = rows.select(
        F.to_timestamp("time").alias("time"), *map(number, ("latitude", "longitude", "depth", "mag")), "place"
    )
    return typed.na.drop(subset=["time", "latitude", "longitude", "mag"]).orderBy("time")


def validation_report(events: DataFrame, grid: Grid = Grid(), min_magnitude: float = MIN_MAGNITUDE) -> DataFrame:
    """One row: number of events and whether all lie in the box and above the threshold."""
    return events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.bool_and(F.col("latitude").between(grid.lat_min, grid.lat_max)).alias("latitude_ok"),
        F.bool_and(F.col("longitude").between(grid.lon_min, grid.lon_max)).alias("longitude_ok"),
        F.bool_and(F.col("mag") >= min_magnitude).alias("magnitude_ok"),
    )


def validate(events: DataFrame, grid: Grid = Grid(), min_magnitude: float = MIN_MAGNITUDE) -> DataFrame:
    """The events, or ValueError if there are none or any is out of bounds."""
    row = validation_report(events, grid, min_magnitude).head()
    if not row.n_events:
        raise ValueError("no events")
    if not (row.latitude_ok and row.longitude_ok and row.magnitude_ok):
        raise ValueError(f"events out of bounds: {row.asDict()}")
    return events


def validate_panel(panel: DataFrame) -> DataFrame:
    """The panel, or ValueError if it is empty or holds a negative count."""
    n, least = panel.agg(F.count(F.lit(1)), F.min("y")).head()
    if not n or least < 0:
        raise ValueError("an empty panel" if not n else f"a negative count: {least}")
    return panel


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and old's whose key new doesn't have; columns by name."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def with_columns_or_zero(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns in order, 0 where the table lacks one."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns))
