"""DuckDB SQL shared by the queries' oracles: events, panel, test forecasts."""

from __future__ import annotations

_PLACED = """SELECT {i} AS event_id, {time} AS time, 38e0 + 3*(k // {n}) + 0.9e0*(({i} % 100) + 0.5e0)/100e0 AS latitude,
    65e0 + 3*(k % {n}) + 0.9e0*(({i} % 89) + 0.5e0)/89e0 AS longitude, {mag} AS mag FROM ({rows})"""

EVENTS = {
    "balanced": _PLACED.format(i="event_id", time="ts", n=7, mag="3e0 + value/100e0", rows="SELECT *, user_id % 21 AS k FROM events"),
    "bursty": _PLACED.format(
        i="event_id", time="ts", n=7, mag="3e0 + value/100e0",
        rows="SELECT *, floor((sqrt(8*(event_id % 231) + 1) - 1)/2)::BIGINT AS k FROM events",
    ),
    "orders": _PLACED.format(
        i="o_orderkey", time="o_orderdate", n=5, mag="3e0 + o_totalprice/125000e0",
        rows="SELECT o.*, c.c_nationkey AS k FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    ),
}
UNIT = {"balanced": "hour", "bursty": "hour", "orders": "week"}


def binned(kind: str) -> str:
    """CTEs ev, binned."""
    return f"""ev AS ({EVENTS[kind]}),
placed AS (SELECT *, floor((latitude - 38e0)/3e0)*3e0 + 38e0 AS lat_grid, floor((longitude - 65e0)/3e0)*3e0 + 65e0 AS lon_grid FROM ev),
binned AS (SELECT *, printf('%.2f_%.2f', lat_grid, lon_grid) AS cell_id, pow(10e0, 1.5e0*mag) AS energy,
  date_trunc('{UNIT[kind]}', time)::TIMESTAMP AS week FROM placed)"""


def base(kind: str) -> str:
    """CTEs up to base: the dense table."""
    return f"""{binned(kind)},
sparse AS (SELECT cell_id, lat_grid, lon_grid, week, count(mag)::BIGINT AS y, max(mag) AS mag_max, min(mag) AS mag_min, sum(energy) AS energy_sum
  FROM binned GROUP BY ALL),
cells AS (SELECT DISTINCT cell_id, lat_grid, lon_grid FROM sparse),
calendar AS (SELECT unnest(generate_series(min(week), max(week), INTERVAL 1 {UNIT[kind]})) AS week FROM sparse),
base AS (SELECT c.cell_id, c.lat_grid, c.lon_grid, k.week, coalesce(s.y, 0)::BIGINT AS y, coalesce(s.mag_max, 0e0) AS mag_max,
    coalesce(s.mag_min, 0e0) AS mag_min, coalesce(s.energy_sum, 0e0) AS energy_sum
  FROM cells c CROSS JOIN calendar k LEFT JOIN sparse s ON s.cell_id = c.cell_id AND s.week = k.week)"""


def panel(kind: str) -> str:
    """CTEs up to panel."""
    return f"""{base(kind)},
feat AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(y) OVER w, 0)::DOUBLE AS y_lag1, coalesce(lag(mag_max) OVER w, 0e0) AS mag_max_lag1,
    coalesce(lag(mag_min) OVER w, 0e0) AS mag_min_lag1,
    coalesce(max(mag_max) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0e0) AS mag_max_roll4,
    coalesce(sum(y) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS count_roll12,
    coalesce(sum(energy_sum) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0e0) AS energy_roll8
  FROM base WINDOW w AS (PARTITION BY cell_id ORDER BY week)),
since AS (SELECT *, coalesce((rn - 1 - max(CASE WHEN mag_max >= 4.5e0 THEN rn END)
    OVER (PARTITION BY cell_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 500e0) AS weeks_since_m45 FROM feat),
panel AS (SELECT * FROM since WHERE rn > 12)"""


def split(kind: str) -> str:
    """CTEs up to train and test: the split by distinct weeks."""
    return f"""{panel(kind)},
weeks AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS place, count(*) OVER () AS n_weeks FROM (SELECT DISTINCT week FROM panel)),
cutoff AS (SELECT week AS cutoff, n_weeks FROM weeks WHERE place = floor(n_weeks*0.8e0)),
train AS (SELECT p.* FROM panel p, cutoff WHERE p.week < cutoff), test AS (SELECT p.* FROM panel p, cutoff WHERE p.week >= cutoff)"""


def predictions(kind: str) -> str:
    """CTEs up to preds: two fixed forecasts of the test rows, the second also as NB."""
    return f"""{split(kind)},
preds AS (
  SELECT 'naive' AS model, 'poisson' AS family, NULL::DOUBLE AS alpha, cell_id, week, y, greatest(y_lag1, 1e-9) AS mu FROM test
  UNION ALL SELECT 'rate_poisson', 'poisson', NULL, cell_id, week, y, 0.1e0 + count_roll12/12e0 FROM test
  UNION ALL SELECT 'rate_nb', 'nb', 0.5e0, cell_id, week, y, 0.1e0 + count_roll12/12e0 FROM test)"""


#: Log-likelihood pieces by log-gamma, independent of the engine's finite sums.
NB_NLL = """(-lgamma(y + 1e0/alpha) + lgamma(y + 1e0) + lgamma(1e0/alpha) - (1e0/alpha)*ln((1e0/alpha)/(1e0/alpha + mu)) - y*ln(mu/(1e0/alpha + mu)))"""
DEVIANCE = "(2e0*(CASE WHEN y > 0 THEN y*ln(y/mu) ELSE 0e0 END - y + mu))"
PMF = """(CASE WHEN family = 'nb'
  THEN exp(lgamma(k + 1e0/alpha) - lgamma(k + 1e0) - lgamma(1e0/alpha) + (1e0/alpha)*ln(1e0/(1e0 + alpha*mu)) + k*ln(alpha*mu/(1e0 + alpha*mu)))
  ELSE exp(k*ln(mu) - mu - lgamma(k + 1e0)) END)"""


def uniform(key: str) -> str:
    return f"((({key})::HUGEINT*2654435761) % 4294967296)::DOUBLE/4294967296e0"
