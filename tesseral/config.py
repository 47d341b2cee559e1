"""Parameters that define the semantics of the engine."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Fixed values of the default study: days, magnitudes, degrees.
START_DATE, END_DATE = "2010-01-01", "2024-01-01"


@dataclass(frozen=True)
class Grid:
    """An anchored square lattice and the time buckets of the panel."""

    lat_min: float = 38.0
    lat_max: float = 45.0
    lon_min: float = 65.0
    lon_max: float = 85.0
    size: float = 3.0
    unit: str = "week"


@dataclass(frozen=True)
class Features:
    """Windows and thresholds of the panel's features."""

    warm_up: int = 12
    max_width: int = 4
    count_width: int = 12
    energy_width: int = 8
    major: float = 4.5
    never: float = 500.0


MIN_MAGNITUDE = 3.0
BIN_WIDTH = 0.1
MC_CORRECTION = 0.2
MIN_EVENTS_B = 10
TRAIN_SHARE = 0.8
FLOOR = 1e-9
PIT_FLOOR = 1e-8
ALPHA_GRID = tuple(10 ** (-3 + 5 * k / 59) for k in range(60))
BASELINE_FEATURES = ("y_lag1", "mag_max_lag1", "mag_min_lag1")
ENHANCED_FEATURES = (*BASELINE_FEATURES, "mag_max_roll4", "count_roll12", "energy_roll8", "weeks_since_m45")
IDENTIFIABILITY_SEEDS = (42, 7, 123, 2024, 999)
LN10 = math.log(10.0)
