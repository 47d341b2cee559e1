"""Queries over catalogues, panels, splits and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.config import ENHANCED_FEATURES, Features, Grid
from tesseral.functions import grid as G
from tesseral.operators import ingest, panel as P, splits, stats
from tesseral.plans import sql
from tesseral.sources import adapters

HOURLY = Grid(unit="hour")
WEEKLY = Grid(lat_max=53.0, lon_max=80.0)
READ = {"balanced": adapters.balanced_events, "bursty": adapters.bursty_events, "orders": adapters.order_events}
GRIDS = {"balanced": HOURLY, "bursty": HOURLY, "orders": WEEKLY}
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in columns]


def binned(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return P.bin_events(READ[kind](spark, sf_dir), GRIDS[kind])


def base(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return P.dense_base(P.aggregate_cells(binned(spark, sf_dir, kind)), GRIDS[kind].unit)


def cutoff(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The first test bucket of the kind's panel."""
    return splits.calendar_cutoff(binned(spark, sf_dir, kind), GRIDS[kind].unit, Features().warm_up)


def cells(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The cells of the kind's panel, without its features."""
    return binned(spark, sf_dir, kind).select("cell_id", "lat_grid", "lon_grid").distinct()


def panel(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return P.build_panel(READ[kind](spark, sf_dir), GRIDS[kind])


_PANEL_SELECT = """SELECT cell_id, week, lat_grid, lon_grid, y_lag1, mag_max_lag1, mag_min_lag1, mag_max_roll4, count_roll12,
  round(log10(1e0 + energy_roll8), 6) AS energy_roll8_log, weeks_since_m45, y FROM panel"""


def _panel_query(kind: str):
    return lambda spark, sf_dir: panel(spark, sf_dir, kind).withColumn("energy_roll8_log", F.round(F.log10(1 + F.col("energy_roll8")), 6)).drop("energy_roll8")


for _name, _kind in (("panel_features", "bursty"), ("panel_features_balanced", "balanced"), ("panel_features_weekly", "orders")):
    query(_name, f"WITH {sql.panel(_kind)} {_PANEL_SELECT}")(_panel_query(_kind))


def _window_query(column: str):
    return lambda spark, sf_dir: panel(spark, sf_dir, "orders").select("cell_id", "week", column)


for _name, _column in (
    ("w1_lag_count", "y_lag1"), ("w1_lag_mag_max", "mag_max_lag1"), ("w1_lag_mag_min", "mag_min_lag1"), ("w2_roll_max", "mag_max_roll4"),
    ("w3_roll_count", "count_roll12"), ("w5_since_major", "weeks_since_m45"),
):
    query(_name, f"WITH {sql.panel('orders')} SELECT cell_id, week, {_column} FROM panel")(_window_query(_column))


@query("w4_roll_energy", f"WITH {sql.panel('orders')} SELECT cell_id, week, round(log10(1e0 + energy_roll8), 6) AS energy_log FROM panel")
def w4_roll_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir, "orders").select("cell_id", "week", F.round(F.log10(1 + F.col("energy_roll8")), 6).alias("energy_log"))


@query(
    "w6_forward_fill",
    f"""WITH {sql.base('orders')} SELECT cell_id, week, last_value(CASE WHEN y > 0 THEN mag_max END IGNORE NULLS)
      OVER (PARTITION BY cell_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_mag FROM base""",
)
def w6_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("cell_id").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("y") > 0, F.col("mag_max"))
    return base(spark, sf_dir, "orders").select("cell_id", "week", F.last(seen, ignorenulls=True).over(w).alias("last_mag"))


@query(
    "w8_mean_gap",
    f"""WITH {sql.binned('bursty')} SELECT cell_id, count(*)::BIGINT AS n,
      round((count(*) - 1)*86400e6/nullif(epoch_us(max(time)) - epoch_us(min(time)), 0), 6) AS rate_per_day FROM binned GROUP BY cell_id""",
)
def w8_mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir, "bursty").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), G.days_between(F.min("time"), F.max("time")).alias("d"))
    return b.select("cell_id", "n", F.round(F.try_divide(F.col("n") - 1, F.col("d")), 6).alias("rate_per_day"))


@query(
    "binned_events",
    f"""WITH {sql.binned('balanced')} SELECT event_id, time, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, lat_grid, lon_grid,
      cell_id, round(log10(1e0 + energy), 6) AS energy_log, week FROM binned""",
)
def binned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir, "balanced").select(
        "event_id", "time", *r6("latitude", "longitude"), "lat_grid", "lon_grid", "cell_id", F.round(F.log10(1 + F.col("energy")), 6).alias("energy_log"), "week"
    )


@query(
    "f_scalars",
    f"""WITH ev AS ({sql.EVENTS['bursty']}) SELECT event_id, year(time) AS year, time + INTERVAL 7 DAYS AS next_week, date_trunc('week', time)::TIMESTAMP AS monday,
      round((epoch_us(time) - epoch_us(TIMESTAMP '2020-01-01'))/86400e6, 6) AS days, round(ln(1e0 + exp(mag - 3e0)), 6) AS softplus,
      greatest(mag - 3.5e0, 0e0) AS relu, round(1e0/(1e0 + exp(3e0 - mag)), 6) AS sigmoid, least(greatest(mag, 3.2e0), 3.8e0) AS clipped FROM ev""",
)
def f_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("mag") - 3
    return READ["bursty"](spark, sf_dir).select(
        "event_id",
        F.year("time").cast("long").alias("year"),
        (F.col("time") + F.expr("INTERVAL 7 DAYS")).alias("next_week"),
        G.bucket_start(F.col("time"), "week").alias("monday"),
        F.round(G.days_between(F.lit("2020-01-01").cast("timestamp_ntz"), F.col("time")), 6).alias("days"),
        F.round(F.log1p(F.exp(x)), 6).alias("softplus"),
        F.greatest(F.col("mag") - 3.5, F.lit(0.0)).alias("relu"),
        F.round(1 / (1 + F.exp(-x)), 6).alias("sigmoid"),
        G.clip(F.col("mag"), 3.2, 3.8).alias("clipped"),
    )


@query("f11_log_space", "SELECT k::BIGINT AS k, round(log10(pow(10e0, -3e0 + 5e0*k/59e0)), 6) AS log_alpha FROM generate_series(0, 59) t(k)")
def f11_log_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(G.log_space(-3, 2, 60)).alias("k", "a")).select(F.col("k").cast("long").alias("k"), F.round(F.log10("a"), 6).alias("log_alpha"))


@query(
    "a1_cell_aggregate",
    f"""WITH {sql.base('bursty')} SELECT cell_id, lat_grid, lon_grid, week, y, mag_max, mag_min, round(log10(1e0 + energy_sum), 6) AS energy_log FROM sparse""",
)
def a1_cell_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.aggregate_cells(binned(spark, sf_dir, "bursty"))
    return s.withColumn("energy_log", F.round(F.log10(1 + F.col("energy_sum")), 6)).drop("energy_sum")


@query("j1_dense_base", f"WITH {sql.base('orders')} SELECT cell_id, week, lat_grid, lon_grid, y, mag_max, mag_min FROM base")
def j1_dense_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "orders").select("cell_id", "week", "lat_grid", "lon_grid", "y", "mag_max", "mag_min")


@query("o7_calendar", f"WITH {sql.base('orders')} SELECT week FROM calendar")
def o7_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "orders").select("week").distinct()


@query(
    "a6_catalogue_summary",
    f"""WITH {sql.binned('balanced')} SELECT count(*)::BIGINT AS n, count(DISTINCT cell_id)::BIGINT AS n_cells, count(DISTINCT week)::BIGINT AS n_weeks,
      min(time) AS first_time, max(time) AS last_time, min(mag) AS min_mag, max(mag) AS max_mag FROM binned""",
)
def a6_catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir, "balanced").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("n_cells"), F.count_distinct("week").alias("n_weeks"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.min("mag").alias("min_mag"), F.max("mag").alias("max_mag"),
    )


@query(
    "a9_reconciliation",
    f"""WITH {sql.base('bursty')}, t AS (SELECT (SELECT count(mag) FROM binned)::BIGINT AS n_events, (SELECT sum(y) FROM sparse)::BIGINT AS n_sparse,
      (SELECT sum(y) FROM base)::BIGINT AS n_dense) SELECT *, n_events > 0 AND n_events = n_sparse AND n_sparse = n_dense AS ok FROM t""",
)
def a9_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = binned(spark, sf_dir, "bursty")
    s = P.aggregate_cells(b)
    return stats.reconciliation(b, s, P.dense_base(s, "hour"))


@query(
    "p_validation_report",
    f"""WITH ev AS ({sql.EVENTS['balanced']}) SELECT count(*)::BIGINT AS n_events, bool_and(latitude BETWEEN 38 AND 45) AS latitude_ok,
      bool_and(longitude BETWEEN 65 AND 85) AS longitude_ok, bool_and(mag >= 3) AS magnitude_ok FROM ev""",
)
def p_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validation_report(READ["balanced"](spark, sf_dir), HOURLY)


#: Hand-made raw rows: nulls, text for numbers, edges, one-decimal magnitudes.
RAW = (
    ("2020-01-01 00:00:00", "40.0", "70.0", "10", "3.3", "a"), ("2020-01-05 23:59:59", "38.0", "65.0", None, "3.0", "b"),
    ("2020-01-06 00:00:00", "41.0", "68.0", "bad", "3.6", None), (None, "40.0", "70.0", "5", "4.5", "d"),
    ("2020-01-08 12:00:00", "x", "70.0", "5", "4.5", "e"), ("2020-01-09 12:00:00", "44.9", None, "5", "4.4", "f"),
    ("2020-01-10 12:00:00", "44.9", "84.9", "5", "", "g"), ("2020-01-11 12:00:00", "44.9", "84.9", "7.5", "5.1", "h"),
    ("2020-01-12 12:00:00", "40.999999", "67.999999", "7.5", "3.9", "i"),
)
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in RAW)
_CLEAN = f"""clean AS (SELECT * FROM (SELECT time::TIMESTAMP AS time, try_cast(latitude AS DOUBLE) AS latitude, try_cast(longitude AS DOUBLE) AS longitude,
  try_cast(depth AS DOUBLE) AS depth, try_cast(mag AS DOUBLE) AS mag, place FROM (VALUES {_VALUES}) t(time, latitude, longitude, depth, mag, place))
  WHERE time IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND mag IS NOT NULL)"""


def _clean(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(RAW, "time string, latitude string, longitude string, depth string, mag string, place string")
    return ingest.clean_catalogue(raw)


@query("p_clean_catalogue", f"WITH {_CLEAN} SELECT * FROM clean")
def p_clean_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(
    "p_binned_literal",
    f"""WITH {_CLEAN} SELECT place, printf('%.2f_%.2f', floor((latitude - 38e0)/3e0)*3e0 + 38e0, floor((longitude - 65e0)/3e0)*3e0 + 65e0) AS cell_id,
      date_trunc('week', time)::TIMESTAMP AS week FROM clean""",
)
def p_binned_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bin_events(_clean(spark)).select("place", "cell_id", "week")


@query(
    "a2_cell_dispersion",
    f"""WITH {sql.panel('bursty')} SELECT cell_id, round(avg(y), 6) AS mean_y, round(var_samp(y), 6) AS var_y,
      round(CASE WHEN avg(y) > 0 THEN var_samp(y)/avg(y) END, 6) AS d_cell FROM panel GROUP BY cell_id""",
)
def a2_cell_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cell_dispersion(panel(spark, sf_dir, "bursty")).select("cell_id", *r6("mean_y", "var_y", "d_cell"))


@query(
    "a3_dispersion_summary",
    f"""WITH {sql.panel('bursty')}, c AS (SELECT CASE WHEN avg(y) > 0 THEN var_samp(y)/avg(y) END AS d FROM panel GROUP BY cell_id),
      g AS (SELECT avg(y) AS m, var_samp(y) AS v FROM panel)
      SELECT round(m, 6) AS mean_y, round(v, 6) AS var_y, round(v/m, 6) AS d, (SELECT round(avg(d), 6) FROM c) AS mean_d_cell,
        (SELECT round(quantile_cont(d, 0.5), 6) FROM c) AS median_d_cell, (SELECT round(avg((d > 1)::INT)*100e0, 6) FROM c) AS pct_above_1,
        (SELECT round(avg((d > 1.5)::INT)*100e0, 6) FROM c) AS pct_above_1_5,
        CASE WHEN v/m <= 1.2 THEN 'poisson plausible' WHEN v/m <= 2 THEN 'moderate overdispersion' ELSE 'strong overdispersion' END AS verdict FROM g""",
)
def a3_dispersion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.dispersion_summary(panel(spark, sf_dir, "bursty"))
    return s.select(*r6("mean_y", "var_y", "d", "mean_d_cell", "median_d_cell", "pct_above_1", "pct_above_1_5"), "verdict")


_HIST = f"""ev AS ({sql.EVENTS['balanced']}), span AS (SELECT floor(min(mag)/0.1e0)*0.1e0 AS lo, ceil(max(mag)/0.1e0)*0.1e0 AS hi FROM ev),
e AS (SELECT k::INT AS k, lo + k*0.1e0 AS edge, n FROM (SELECT lo, ceil((hi + 0.1e0 - lo)/0.1e0)::BIGINT AS n FROM span), generate_series(0, 4000) t(k) WHERE k < n),
bins AS (SELECT a.k AS bin, a.edge AS low, b.edge AS high, 0.5e0*(a.edge + b.edge) AS center, a.k = a.n - 2 AS is_last FROM e a JOIN e b ON b.k = a.k + 1),
hist AS (SELECT bin, low, center, count(mag)::BIGINT AS n FROM bins LEFT JOIN ev ON mag >= low AND (mag < high OR (is_last AND mag <= high)) GROUP BY ALL)"""


@query("a10_magnitude_histogram", f"WITH {_HIST} SELECT bin, round(low, 6) AS low, round(center, 6) AS center, n, (sum(n) OVER (ORDER BY bin DESC))::BIGINT AS n_at_least FROM hist")
def a10_magnitude_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.magnitude_histogram(READ["balanced"](spark, sf_dir)).select("bin", *r6("low", "center"), "n", "n_at_least")


@query(
    "a15_completeness",
    f"""WITH {_HIST}, m AS (SELECT round_even((center + 0.2e0)/0.1e0, 0)*0.1e0 AS m_c FROM hist ORDER BY n DESC, bin LIMIT 1)
      SELECT round(m_c, 6) AS m_c_estimate, round(CASE WHEN count(*) FILTER (mag >= m_c) >= 10
          THEN 1e0/(ln(10e0)*(avg(mag) FILTER (mag >= m_c) - m_c + 0.05e0)) END, 6) AS b_value,
        (count(*) FILTER (mag >= m_c))::BIGINT AS n_used, count(*)::BIGINT AS n_total, 'maximum curvature' AS method FROM ev, m GROUP BY m_c""",
)
def a15_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.completeness(READ["balanced"](spark, sf_dir)).select(*r6("m_c_estimate", "b_value"), "n_used", "n_total", "method")


@query("a23_value_counts", f"WITH {sql.panel('bursty')} SELECT y, count(*)::BIGINT AS n FROM panel GROUP BY y")
def a23_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(panel(spark, sf_dir, "bursty"))


@query("a24_zero_share", f"WITH {sql.panel('bursty')} SELECT round(avg((y = 0)::INT)*100e0, 6) AS zero_pct, count(*)::BIGINT AS n FROM panel")
def a24_zero_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zero_share(panel(spark, sf_dir, "bursty")).select(*r6("zero_pct"), "n")


@query("a22_busiest_cell", f"WITH {sql.panel('orders')} SELECT cell_id, sum(y)::BIGINT AS total FROM panel GROUP BY cell_id ORDER BY total DESC, cell_id LIMIT 1")
def a22_busiest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.busiest_cell(panel(spark, sf_dir, "orders"))


@query(
    "o5_last_buckets",
    f"""WITH {sql.panel('orders')}, b AS (SELECT cell_id, sum(y) AS total FROM panel GROUP BY cell_id ORDER BY total DESC, cell_id LIMIT 1)
      SELECT cell_id, week, y, rank::INT AS rank FROM (SELECT p.cell_id, week, y, row_number() OVER (ORDER BY week DESC) AS rank FROM panel p JOIN b USING (cell_id)) WHERE rank <= 52""",
)
def o5_last_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_buckets(panel(spark, sf_dir, "orders"))


@query(
    "v3_dispersion_histogram",
    f"""WITH {sql.panel('bursty')}, c AS (SELECT CASE WHEN avg(y) > 0 THEN var_samp(y)/avg(y) END AS d FROM panel GROUP BY cell_id),
      s AS (SELECT min(d) AS lo, (max(d) - min(d))/30e0 AS w FROM c), b AS (SELECT k::INT AS bin, lo, w FROM s, generate_series(0, 29) t(k))
      SELECT bin, round(lo + bin*w, 6) AS low, round(lo + (bin + 1)*w, 6) AS high, count(d)::BIGINT AS n
      FROM b LEFT JOIN c ON least(floor((d - lo)/w), 29) = bin GROUP BY ALL""",
)
def v3_dispersion_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stats.equal_width_histogram(stats.cell_dispersion(panel(spark, sf_dir, "bursty")), "d_cell", 30)
    return h.select("bin", *r6("low", "high"), "n")


@query(
    "v2_mean_variance",
    f"""WITH {sql.panel('bursty')}, c AS (SELECT cell_id, avg(y) AS m, var_samp(y) AS v FROM panel GROUP BY cell_id HAVING avg(y) > 0 AND var_samp(y) > 0)
      SELECT cell_id, round(m, 6) AS mean_y, round(v, 6) AS var_y, round(avg(v) OVER ()/avg(m) OVER (), 6) AS ratio FROM c""",
)
def v2_mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_variance(panel(spark, sf_dir, "bursty")).select("cell_id", *r6("mean_y", "var_y", "ratio"))


@query("w9_week_cutoff", f"WITH {sql.split('orders')} SELECT cutoff, n_weeks::INT AS n_weeks FROM cutoff")
def w9_week_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff(spark, sf_dir, "orders")


@query(
    "w9_split_counts",
    f"WITH {sql.split('orders')} SELECT week >= cutoff AS is_test, count(*)::BIGINT AS n, sum(y)::BIGINT AS events FROM panel, cutoff GROUP BY 1",
)
def w9_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_week(panel(spark, sf_dir, "orders"), cutoff=cutoff(spark, sf_dir, "orders")).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))


def _tail(order: str):
    return lambda spark, sf_dir: splits.tail_by_row(panel(spark, sf_dir, "orders"), 0.15, order).select("cell_id", "week", "in_tail")


for _order, _keys in (("chronological", "week, cell_id"), ("cell_major", "cell_id, week")):
    query(
        f"w10_tail_{_order}",
        f"""WITH {sql.panel('orders')} SELECT cell_id, week, row_number() OVER (ORDER BY {_keys}) > count(*) OVER () - floor(count(*) OVER ()*0.15e0) AS in_tail FROM panel""",
    )(_tail(_order))


@query(
    "w11_year_folds",
    f"""WITH {sql.panel('orders')} SELECT fold::INT AS fold, year(week) = fold AS is_test, count(*)::BIGINT AS n, sum(y)::BIGINT AS events
      FROM panel, (VALUES (1998), (1999), (2000), (2001)) f(fold) WHERE year(week) <= fold GROUP BY ALL""",
)
def w11_year_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = splits.year_folds(panel(spark, sf_dir, "orders"), (1998, 1999, 2000, 2001))
    return folds.groupBy("fold", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))


def _encoded(order: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel(spark, sf_dir, "bursty")
        return splits.encode_cells(rows.where("cell_id < '44'"), rows, order).select("cell_id", "cell_idx").distinct()

    return run


for _order, _key in (("sorted", "cell_id"), ("first_seen", "min(week), cell_id")):
    query(
        f"w12_encode_{_order}",
        f"""WITH {sql.panel('bursty')}, c AS (SELECT cell_id, row_number() OVER (ORDER BY {_key}) - 1 AS code FROM panel WHERE cell_id < '44' GROUP BY cell_id)
          SELECT DISTINCT p.cell_id, coalesce(code, (SELECT count(*) FROM c))::BIGINT AS cell_idx FROM panel p LEFT JOIN c USING (cell_id)""",
    )(_encoded(_order))


_SCALER = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END, 6) AS scale FROM (SELECT {c} AS x FROM train)"
    for c in ENHANCED_FEATURES
)


#: Energies are too great for a comparison of rounded values, so their logarithms are compared.
_SCALED = "CASE WHEN feature = 'energy_roll8' THEN round(log10({x}), 6) ELSE round({x}, 6) END AS {x}"


@query("a26_scaler", f"WITH {sql.split('orders')}, s AS ({_SCALER}) SELECT feature, {_SCALED.format(x='mean')}, {_SCALED.format(x='scale')} FROM s")
def a26_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.split_by_week(panel(spark, sf_dir, "orders")).where("NOT is_test")
    shown = lambda c: F.round(F.when(F.col("feature") == "energy_roll8", F.log10(c)).otherwise(F.col(c)), 6).alias(c)
    return splits.fit_scaler(rows, ENHANCED_FEATURES).select("feature", shown("mean"), shown("scale"))


@query(
    "k4_upsert",
    """SELECT 'a' AS model, 1e0 AS mae, NULL::VARCHAR AS status UNION ALL SELECT 'b', 5e0, 'OK' UNION ALL SELECT 'c', 6e0, 'OK'""",
)
def k4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, mae double")
    new = spark.createDataFrame([("b", 5.0, "OK"), ("c", 6.0, "OK")], "model string, mae double, status string")
    return ingest.upsert(old, new, "model")


@query("p17_reindex_columns", f"WITH {sql.panel('orders')} SELECT cell_id, week, y_lag1, 0e0 AS other FROM panel")
def p17_reindex_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.with_columns_or_zero(panel(spark, sf_dir, "orders"), ("cell_id", "week", "y_lag1", "other"))
    return rows
