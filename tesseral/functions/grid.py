"""Column expressions of the lattice, the time buckets and the energy proxy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_floor(x: Column, origin: float, size: float) -> Column:
    """The lower edge of the lattice cell that holds x."""
    return F.floor((x - origin) / size) * F.lit(size) + F.lit(origin)


def cell_key(lat: Column, lon: Column) -> Column:
    """'lat_lon' with two decimals each, half-even."""
    return F.format_string("%.2f_%.2f", F.bround(lat, 2), F.bround(lon, 2))


def energy(mag: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(1.5) * mag)


def bucket_start(time: Column, unit: str) -> Column:
    """Start of the hour, day or (Monday's) week, without time zone."""
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from start to end."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(86_400e6)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def log_space(low: float, high: float, n: int) -> Column:
    """n powers of ten from 10**low to 10**high, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.pow(F.lit(10.0), F.lit(float(low)) + F.lit(float(high - low)) * k / F.lit(float(n - 1))))


def edges(low: Column, high: Column, width: float) -> Column:
    """low, low + width, ... below high + width, each as low + k * width."""
    n = F.ceil((high + F.lit(width) - low) / F.lit(width)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: low + k * F.lit(width))


def portable_uniform(key: Column) -> Column:
    """A number in [0, 1) from an integer, the same in every engine."""
    return F.pmod(key.cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(10,0)"), F.lit(4294967296).cast("decimal(10,0)")).cast("double") / F.lit(
        4294967296.0
    )
