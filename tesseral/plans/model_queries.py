"""Queries over forecasts, metrics, calibration, residuals and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import ENHANCED_FEATURES, IDENTIFIABILITY_SEEDS
from tesseral.functions import dist, grid as G
from tesseral.operators import etas, evaluation as V, glm, metrics as M, spatial, splits, stats
from tesseral.plans import sql, study
from tesseral.plans.panel_queries import READ, binned, cells, cutoff, panel, r6
from tesseral.sources import keyed
from tesseral.sources.staging import shared_folder, stage

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FORECASTS = {"naive": ("naive", "poisson", None), "rate_poisson": ("rate", "poisson", None), "rate_nb": ("rate", "nb", 0.5)}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def forecasts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Test rows with two fixed forecasts, the second also as negative binomial."""
    test = splits.split_by_week(panel(spark, sf_dir, kind), cutoff=cutoff(spark, sf_dir, kind)).where("is_test")
    wide = test.withColumn("naive", F.col("y_lag1")).withColumn("rate", F.lit(0.1) + F.col("count_roll12") / 12)
    return M.predictions_long(wide, FORECASTS)


@query(
    "g1_persistence_metrics",
    f"""WITH {sql.predictions('orders')} SELECT model, count(*)::BIGINT AS n, round(avg(abs(y - mu)), 6) AS mae, round(sqrt(avg((y - mu)**2)), 6) AS rmse,
      round(avg({sql.DEVIANCE}), 6) AS mpd, round(avg(2e0*(CASE WHEN y > 0 THEN y*ln(y/mu + 1e-9) ELSE 0e0 END - y + mu)), 6) AS mpd_guarded
      FROM preds GROUP BY model""",
)
def g1_persistence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.basic_metrics(forecasts(spark, sf_dir, "orders"), "model").select("model", "n", *r6("mae", "rmse", "mpd", "mpd_guarded"))


@query(
    "m5_likelihoods",
    f"""WITH {sql.predictions('bursty')} SELECT cell_id, week, round(mu - y*ln(mu), 6) AS poisson, round(mu - y*ln(mu) + lgamma(y + 1e0), 6) AS poisson_full,
      round({sql.NB_NLL}, 6) AS nb FROM preds WHERE model = 'rate_nb'""",
)
def m5_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = forecasts(spark, sf_dir, "bursty").where("model = 'rate_nb'")
    y, mu, a = F.col("y"), F.col("mu"), F.col("alpha")
    return p.select("cell_id", "week", dist.poisson_nll(y, mu).alias("poisson"), dist.poisson_nll_full(y, mu).alias("poisson_full"), dist.nb_nll(y, mu, a).alias("nb")).select(
        "cell_id", "week", *r6("poisson", "poisson_full", "nb")
    )


@query(
    "m8_cdf",
    f"""WITH {sql.predictions('bursty')}, d AS (SELECT DISTINCT model, family, alpha, y, mu FROM preds WHERE model <> 'naive'),
      f AS (SELECT d.*, {sql.PMF} AS pmf FROM d, generate_series(0, 100) t(k) WHERE k <= y)
      SELECT model, y, round(mu, 6) AS mu, round(sum(pmf), 6) AS cdf FROM f GROUP BY model, y, f.mu""",
)
def m8_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = forecasts(spark, sf_dir, "bursty").where("model != 'naive'").select("model", "family", "alpha", "y", "mu").distinct()
    # Rounded in a step of its own: a lambda would see an alias of the same select.
    return d.withColumn("cdf", dist.cdf(F.col("family"), F.col("y"), F.col("mu"), F.col("alpha"))).select("model", "y", *r6("mu", "cdf"))


_STRATA = """q AS (SELECT model, quantile_cont(y::DOUBLE, 0.25) AS q25, quantile_cont(y::DOUBLE, 0.5) AS q50, quantile_cont(y::DOUBLE, 0.75) AS q75 FROM preds GROUP BY model),
lab AS (SELECT p.*, unnest(list_filter([CASE WHEN y <= q25 THEN 'Q1 (low)' END, CASE WHEN y > q25 AND y <= q50 THEN 'Q2' END,
  CASE WHEN y > q50 AND y <= q75 THEN 'Q3' END, CASE WHEN y > q75 THEN 'Q4 (high)' END, CASE WHEN y >= 5 THEN 'Y>=5' END, 'All'], lambda x: x IS NOT NULL)) AS stratum
  FROM preds p JOIN q USING (model))"""


@query("m12_strata", f"WITH {sql.predictions('bursty')}, {_STRATA} SELECT model, stratum, count(*)::BIGINT AS n, sum(y)::BIGINT AS events FROM lab GROUP BY ALL")
def m12_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_strata(forecasts(spark, sf_dir, "bursty")).groupBy("model", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))


@query(
    "m13_tail_evaluation",
    f"""WITH {sql.predictions('bursty')}, {_STRATA}, kk AS (SELECT model, stratum, floor(quantile_cont(y::DOUBLE, 0.99))::BIGINT + 20 AS k_max FROM lab GROUP BY ALL),
      u AS (SELECT model, stratum, family, alpha, y, mu, count(*) AS c FROM lab GROUP BY ALL),
      t AS (SELECT u.*, k, k_max, least(sum({sql.PMF}) OVER (PARTITION BY u.model, u.stratum, y, mu ORDER BY k), 1e0) AS cdf
        FROM u JOIN kk ON kk.model = u.model AND kk.stratum = u.stratum, generate_series(0, 200) g(k) WHERE k <= k_max),
      s AS (SELECT model, stratum, family, alpha, y, mu, any_value(c) AS c, sum((cdf - CASE WHEN y <= k THEN 1e0 ELSE 0e0 END)**2) AS crps FROM t GROUP BY ALL),
      v AS (SELECT *, CASE WHEN family = 'nb' THEN {sql.NB_NLL} ELSE mu - y*ln(mu) END AS nll,
        CASE WHEN family = 'nb' THEN {sql.NB_NLL} ELSE mu - y*ln(mu) + lgamma(y + 1e0) END AS nll_full FROM s)
      SELECT model, stratum, sum(c)::BIGINT AS n, round(sum(c*abs(y - mu))/sum(c), 6) AS mae, round(sqrt(sum(c*(y - mu)**2)/sum(c)), 6) AS rmse,
        round(sum(c*{sql.DEVIANCE})/sum(c), 6) AS mpd, round(sum(c*nll)/sum(c), 6) AS nll, round(sum(c*nll_full)/sum(c), 6) AS nll_full,
        round(sum(c*crps)/sum(c), 6) AS crps FROM v GROUP BY ALL""",
)
def m13_tail_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tail_evaluation(forecasts(spark, sf_dir, "bursty")).select("model", "stratum", "n", *r6("mae", "rmse", "mpd", "nll", "nll_full", "crps"))


#: A row's uniform comes from its hour and cell, so that models share it.
_KEY = "(epoch_us(week) // 3600000000) * 1000 + (split_part(cell_id, '_', 1)::DOUBLE*10 + split_part(cell_id, '_', 2)::DOUBLE)::BIGINT"
_PIT = f"""{sql.predictions('bursty')}, d AS (SELECT *, {sql.uniform(_KEY)} AS u FROM preds WHERE model <> 'naive'),
f AS (SELECT DISTINCT model AS fm, family, alpha, y AS fy, mu AS fmu FROM d),
c AS (SELECT fm, fy, fmu, least(sum(pmf), 1e0) AS cdf_y, least(coalesce(sum(pmf) FILTER (k < fy), 0e0), 1e0) AS cdf_prev
  FROM (SELECT fm, fy, fmu, k, {sql.PMF.replace('mu', 'fmu')} AS pmf FROM f, generate_series(0, 100) t(k) WHERE k <= fy) GROUP BY ALL),
pits AS (SELECT d.model, cell_id, week, least(greatest(cdf_prev + u*(cdf_y - cdf_prev), 0e0), 1e0) AS pit FROM d JOIN c ON fm = model AND fy = y AND fmu = mu)"""


def _pits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("cell_id", "_")
    place = F.round(F.get(parts, F.lit(0)).cast("double") * 10 + F.get(parts, F.lit(1)).cast("double")).cast("long")
    hour = F.floor(F.unix_micros(F.col("week").cast("timestamp")) / 3_600_000_000).cast("long")
    rows = forecasts(spark, sf_dir, "bursty").where("model != 'naive'").withColumn("u", G.portable_uniform(hour * 1000 + place))
    return M.pit_values(rows, "u")


@query("m15_pit", f"WITH {_PIT} SELECT model, cell_id, week, round(pit, 6) AS pit FROM pits")
def m15_pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pits(spark, sf_dir).select("model", "cell_id", "week", *r6("pit"))


_PIT_HIST = f"""{_PIT}, h AS (SELECT model, least(floor(pit*10), 9)::BIGINT AS bin, count(*) AS n FROM pits GROUP BY ALL),
hist AS (SELECT m.model, b.bin::INT AS bin, coalesce(h.n, 0)::BIGINT AS n, coalesce(h.n, 0)/sum(coalesce(h.n, 0)) OVER (PARTITION BY m.model) AS freq
  FROM (SELECT DISTINCT model FROM pits) m CROSS JOIN generate_series(0, 9) b(bin) LEFT JOIN h ON h.model = m.model AND h.bin = b.bin)"""


@query("a11_pit_histogram", f"WITH {_PIT_HIST} SELECT model, bin, n, round(freq, 6) AS freq FROM hist")
def a11_pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pit_histogram(_pits(spark, sf_dir)).select("model", "bin", "n", *r6("freq"))


@query(
    "m16_calibration",
    f"""WITH {_PIT_HIST}, o AS (SELECT model, avg(abs(freq - 0.1e0)) AS l1 FROM hist GROUP BY model)
      SELECT model, count(*)::BIGINT AS n, round(avg(pit), 6) AS pit_mean, round(var_samp(pit), 6) AS pit_var, round(any_value(l1), 6) AS pit_l1_uniform
      FROM pits JOIN o USING (model) GROUP BY model""",
)
def m16_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_summary(_pits(spark, sf_dir)).select("model", "n", *r6("pit_mean", "pit_var", "pit_l1_uniform"))


_RESIDUAL = "(y - mu)/sqrt(greatest(mu + CASE WHEN family = 'nb' THEN coalesce(alpha, 0)*mu*mu ELSE 0 END, 1e-9))"


@query(
    "m18_pearson_residuals",
    f"WITH {sql.predictions('orders')} SELECT model, cell_id, week, round({_RESIDUAL}, 6) AS residual FROM preds WHERE model <> 'naive'",
)
def m18_pearson_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pearson_residuals(forecasts(spark, sf_dir, "orders").where("model != 'naive'")).select("model", "cell_id", "week", *r6("residual"))


@query(
    "m23_prediction_band",
    f"""WITH {sql.predictions('orders')}, b AS (SELECT *, sqrt(mu + coalesce(alpha, 0)*mu*mu) AS sd FROM preds) SELECT model, cell_id, week,
      round(greatest(mu - 1.96e0*sd, 0e0), 6) AS low, round(mu + 1.96e0*sd, 6) AS high FROM b WHERE model <> 'naive'""",
)
def m23_prediction_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prediction_band(forecasts(spark, sf_dir, "orders").where("model != 'naive'")).select("model", "cell_id", "week", *r6("low", "high"))


_WEIGHTS = """w0 AS (SELECT a.cell_id AS cell_i, b.cell_id AS cell_j FROM cells a JOIN cells b
  ON abs(a.lat_grid - b.lat_grid) <= 3.03e0 AND abs(a.lon_grid - b.lon_grid) <= 3.03e0 AND a.cell_id <> b.cell_id),
w AS (SELECT *, 1e0/count(*) OVER (PARTITION BY cell_i) AS w FROM w0)"""


@query("m19_queen_weights", f"WITH {sql.base('bursty')}, {_WEIGHTS} SELECT cell_i, cell_j, round(w, 6) AS w FROM w")
def m19_queen_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.queen_weights(cells(spark, sf_dir, "bursty")).select("cell_i", "cell_j", *r6("w"))


_CELL_MEANS = f"""r AS (SELECT model, cell_id, avg({_RESIDUAL}) AS x FROM preds WHERE model <> 'naive' GROUP BY ALL),
xs AS (SELECT m.model, c.cell_id, coalesce(r.x, 0e0) AS x FROM (SELECT DISTINCT model FROM r) m CROSS JOIN cells c LEFT JOIN r ON r.model = m.model AND r.cell_id = c.cell_id)"""


def _residual_means(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = M.pearson_residuals(stage(forecasts(spark, sf_dir, "orders").where("model != 'naive'")))
    places = stage(cells(spark, sf_dir, "orders"))
    return spatial.cell_means(rows, places, "residual"), spatial.queen_weights(places)


@query("a21_cell_means", f"WITH {sql.predictions('orders')}, {_CELL_MEANS} SELECT model, cell_id, round(x, 6) AS x FROM xs")
def a21_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residual_means(spark, sf_dir)[0].select("model", "cell_id", *r6("x"))


@query(
    "m20_morans_i",
    f"""WITH {sql.predictions('orders')}, {_CELL_MEANS}, {_WEIGHTS}, z AS (SELECT model, cell_id, x - avg(x) OVER (PARTITION BY model) AS z, count(*) OVER (PARTITION BY model) AS n FROM xs)
      SELECT i.model, round(any_value(i.n)*sum(w.w*i.z*j.z)/(sum(w.w)*(SELECT sum(z*z) FROM z k WHERE k.model = i.model)), 6) AS moran_i
      FROM w JOIN z i ON i.cell_id = w.cell_i JOIN z j ON j.cell_id = w.cell_j AND j.model = i.model GROUP BY i.model""",
)
def m20_morans_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, weights = _residual_means(spark, sf_dir)
    return spatial.morans_i(stage(values), stage(weights)).select("model", *r6("moran_i"))


#: A comparison that holds an alpha for one of the two models.
_COMPARISON = [("rate_nb", 0.5), ("other_nb", 2.0), ("rate_poisson", None)]


def _compared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_COMPARISON, "model string, alpha_hat double")


@query(
    "j11_alpha_by_model",
    f"""WITH {sql.predictions('orders')}, c(model, alpha_hat) AS (VALUES ('rate_nb', 0.5e0), ('other_nb', 2e0), ('rate_poisson', NULL))
      SELECT p.model, cell_id, week, CASE WHEN family = 'nb' THEN coalesce(alpha_hat, 1e0) END AS alpha FROM preds p LEFT JOIN c USING (model)""",
)
def j11_alpha_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_alpha(forecasts(spark, sf_dir, "orders"), _compared(spark)).select("model", "cell_id", "week", "alpha")


@query("m22_spatial_diagnostics", ORACLE_SQL["m20_morans_i"])
def m22_spatial_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(forecasts(spark, sf_dir, "orders").where("model != 'naive'"))
    return V.spatial_diagnostics(rows, _compared(spark), stage(cells(spark, sf_dir, "orders"))).select("model", *r6("moran_i"))


@query(
    "v8_deviance_by_stratum",
    f"""WITH t AS ({ORACLE_SQL['m13_tail_evaluation']}) SELECT model, {", ".join(f'any_value(mpd) FILTER (stratum = {chr(39)}{x}{chr(39)}) AS "{x}"' for x in M.STRATA[:-1])} FROM t GROUP BY model""",
)
def v8_deviance_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = M.deviance_by_stratum(M.tail_evaluation(forecasts(spark, sf_dir, "bursty")))
    return wide.select("model", *(F.round(F.col(f"`{x}`"), 6).alias(x) for x in M.STRATA[:-1]))


@query(
    "v10_alpha_histogram",
    f"""WITH {sql.predictions('bursty')}, d AS (SELECT mu FROM preds WHERE model = 'rate_nb'), s AS (SELECT min(mu) AS lo, (max(mu) - min(mu))/40e0 AS w FROM d),
      b AS (SELECT k::INT AS bin, lo, w FROM s, generate_series(0, 39) t(k))
      SELECT bin, round(lo + bin*w, 6) AS low, round(lo + (bin + 1)*w, 6) AS high, count(mu)::BIGINT AS n FROM b LEFT JOIN d ON least(floor((mu - lo)/w), 39) = bin GROUP BY ALL""",
)
def v10_alpha_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir, "bursty").where("model = 'rate_nb'").withColumn("alpha_pred", F.col("mu"))
    return stats.alpha_histogram(rows).select("bin", *r6("low", "high"), "n")


@query(
    "v5_forecast_series",
    f"""WITH {sql.split('orders')}, b AS (SELECT cell_id FROM test GROUP BY cell_id ORDER BY sum(y) DESC, cell_id LIMIT 1)
      SELECT cell_id, week, y, y_lag1 AS naive, round(0.1e0 + count_roll12/12e0, 6) AS rate FROM test JOIN b USING (cell_id)""",
)
def v5_forecast_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = splits.split_by_week(panel(spark, sf_dir, "orders"), cutoff=cutoff(spark, sf_dir, "orders")).where("is_test")
    wide = test.withColumn("naive", F.col("y_lag1")).withColumn("rate", F.round(F.lit(0.1) + F.col("count_roll12") / 12, 6))
    return stats.forecast_series(wide, "naive", "rate", "pred_dl")


@query("m21_permutation_test")
def m21_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.permutation_test(*_residual_means(spark, sf_dir)).select("model", *r6("moran_i", "z_score", "p_perm"), (F.col("p_perm") < 0.05).alias("significant"))


#: Closed-form coefficients for scoring checks.
BETA = (0.2, 0.1, 0.05, -0.05, 0.02, 0.03, 0.01, -0.001)
#: Closed-form coefficients score the panel with energy on a log scale, as no scaler is fitted for them.
_ETA = " + ".join([f"{BETA[0]}e0", *(f"{b}e0*{'log10(1e0 + energy_roll8)' if c == 'energy_roll8' else c}" for c, b in zip(ENHANCED_FEATURES, BETA[1:], strict=True))])


@query("g5_glm_predict", f"WITH {sql.panel('orders')} SELECT cell_id, week, round(greatest(exp({_ETA}), 1e-9), 6) AS mu FROM panel")
def g5_glm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.log_energy(panel(spark, sf_dir, "orders")).select("cell_id", "week", F.round(glm.predict(ENHANCED_FEATURES, BETA), 6).alias("mu"))


@query("g2_poisson_fit")
def g2_poisson_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = V.scaled_split(panel(spark, sf_dir, "orders"), ENHANCED_FEATURES)
    fit = glm.fit_poisson(train, ENHANCED_FEATURES)
    return spark.createDataFrame([(n, round(float(b), 5), round(fit.llf, 4)) for n, b in zip(("intercept", *ENHANCED_FEATURES), fit.beta, strict=True)], "term string, beta double, llf double")


@query("g4_nb_profile")
def g4_nb_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = V.scaled_split(panel(spark, sf_dir, "bursty"), ENHANCED_FEATURES)
    fit = glm.fit_nb(train, ENHANCED_FEATURES)
    return spark.createDataFrame([(round(a, 9), round(v, 4), a == fit.alpha) for a, v in fit.profile], "alpha double, llf double, is_best boolean")


@query("g6_classical_models")
def g6_classical_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.classical_models(panel(spark, sf_dir, "orders"))[0]


@query("m17_overdispersion_test")
def m17_overdispersion_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lr_test(panel(spark, sf_dir, "bursty"))


#: Fixed parameters of the forecast and likelihood checks.
_FIXED = dict(mu=0.5, k=0.2, c=0.05, p=1.2, a=0.8)
_AREA = "0.2e0*exp(0.8e0*(mag - 3e0))*(({d1})**(-0.2e0) - ({d0})**(-0.2e0))/(-0.2e0)"


def _fixed(times: DataFrame) -> DataFrame:
    return times.select("cell_id").distinct().select("cell_id", *(F.lit(v).alias(k) for k, v in _FIXED.items()))


@query(
    "g19_etas_likelihood",
    f"""WITH {sql.binned('orders')}, o AS (SELECT min(time) AS origin FROM binned),
      e AS (SELECT cell_id, mag, (epoch_us(time) - epoch_us(origin))/86400e6 AS t, row_number() OVER (PARTITION BY cell_id ORDER BY time, mag) AS i FROM binned, o),
      lam AS (SELECT x.cell_id, x.i, any_value(x.t) AS t, any_value(x.mag) AS mag, 0.5e0 + coalesce(sum(0.2e0*exp(0.8e0*(z.mag - 3e0))/(x.t - z.t + 0.05e0)**1.2e0), 0) AS lam
        FROM e x LEFT JOIN e z ON z.cell_id = x.cell_id AND z.i < x.i GROUP BY x.cell_id, x.i),
      f AS (SELECT *, max(t) OVER (PARTITION BY cell_id) AS t_end FROM lam)
      SELECT cell_id, round(0.5e0*any_value(t_end) + sum({_AREA.format(d1="t_end - t + 0.05e0", d0="0.05e0")}) - sum(ln(greatest(lam, 1e-12))), 4) AS nll FROM f GROUP BY cell_id""",
)
def g19_etas_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, by the kernel that fits."""
    times = etas.event_times(binned(spark, sf_dir, "orders"))
    return etas.likelihood(times, _fixed(times)).select("cell_id", F.round("nll", 4).alias("nll"))


@query("g19_etas_likelihood_bursty")
def g19_etas_likelihood_bursty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over cells of very unequal numbers of events; tested against the pairwise table."""
    times = etas.event_times(binned(spark, sf_dir, "bursty"))
    return etas.likelihood(times, _fixed(times)).select("cell_id", F.round("nll", 5).alias("nll"))


@query(
    "g22_etas_forecast",
    f"""WITH {sql.split('orders')}, b AS (SELECT b.* FROM binned b, cutoff WHERE time < cutoff), o AS (SELECT min(time) AS origin FROM b),
      e AS (SELECT cell_id, mag, (epoch_us(time) - epoch_us(origin))/86400e6 AS t FROM b, o),
      wk AS (SELECT DISTINCT cell_id, week, (epoch_us(week) - epoch_us(origin))/86400e6 AS s FROM test, o)
      SELECT wk.cell_id, week, CASE WHEN count(e.t) = 0 THEN 0.1e0 ELSE round(greatest(3.5e0 + coalesce(sum({_AREA.format(d1="s + 7 - t + 0.05e0", d0="greatest(s, t) - t + 0.05e0")})
        FILTER (greatest(s, t) < s + 7), 0), 1e-9), 5) END AS lambda_pred FROM wk LEFT JOIN e ON e.cell_id = wk.cell_id GROUP BY wk.cell_id, week, s""",
)
def g22_etas_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir, "orders")
    first = cutoff(spark, sf_dir, "orders")
    times = stage(etas.event_times(binned(spark, sf_dir, "orders"), F.lit(first.head().cutoff)))
    weeks = splits.split_by_week(rows, cutoff=first).where("is_test").select("cell_id", "week")
    return etas.forecast(weeks, times, _fixed(times)).select("cell_id", "week", F.round("lambda_pred", 5).alias("lambda_pred"))


@query("g21_etas_fit")
def g21_etas_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = etas.event_times(binned(spark, sf_dir, "bursty"))
    return etas.fit_cells(times).select("cell_id", *(F.round(c, 3).alias(c) for c in ("mu", "k", "c", "p", "a", "nll")), "fallback", "n_events")


@query("g24_etas_static")
def g24_etas_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = V.etas_static(binned(spark, sf_dir, "orders"), panel(spark, sf_dir, "orders"), 7.0)
    return M.basic_metrics(scored)


@query("g17_network_ablation")
def g17_network_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tail_evaluation(V.network_predictions(panel(spark, sf_dir, "orders")).where("error IS NULL")).where("stratum = 'All'")


@query("g18_identifiability")
def g18_identifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.alpha_audit(V.identifiability(panel(spark, sf_dir, "orders"), IDENTIFIABILITY_SEEDS), "seed")


@query(
    "a18_alpha_audit",
    f"""WITH {sql.predictions('bursty')} SELECT model, count(*)::BIGINT AS n, round(avg(mu), 6) AS mean_alpha, round(quantile_cont(mu, 0.5), 6) AS median_alpha,
      round(quantile_cont(mu, 0.1), 6) AS q10_alpha, round(quantile_cont(mu, 0.9), 6) AS q90_alpha, round(avg((mu < 1e-2)::INT), 6) AS share_alpha_below_1e_2 FROM preds GROUP BY model""",
)
def a18_alpha_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir, "bursty").withColumn("alpha_pred", F.col("mu"))
    return stats.alpha_audit(rows, "model").select("model", "n", *r6("mean_alpha", "median_alpha", "q10_alpha", "q90_alpha", "share_alpha_below_1e_2"))


@query(
    "j4_default_join",
    f"""WITH {sql.split('orders')}, p AS (SELECT cell_id, week, 0.5e0 + y_lag1 AS lambda_pred FROM test WHERE cell_id < '44')
      SELECT t.cell_id, t.week, t.y, greatest(coalesce(lambda_pred, 0.1e0), 1e-9) AS mu FROM test t LEFT JOIN p ON p.cell_id = t.cell_id AND p.week = t.week""",
)
def j4_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = splits.split_by_week(panel(spark, sf_dir, "orders"), cutoff=cutoff(spark, sf_dir, "orders")).where("is_test")
    pred = test.where("cell_id < '44'").select("cell_id", "week", (F.lit(0.5) + F.col("y_lag1")).alias("lambda_pred"))
    return test.select("cell_id", "week", "y").join(pred, ["cell_id", "week"], "left").select(
        "cell_id", "week", "y", F.greatest(F.coalesce("lambda_pred", F.lit(0.1)), F.lit(1e-9)).alias("mu")
    )


_WF = f"""{sql.panel('orders')}, f AS (SELECT fold::INT AS year, p.* FROM panel p, (VALUES (1998), (1999), (2000), (2001)) f(fold) WHERE year(week) = fold),
m AS (SELECT year, 'naive' AS model, y, greatest(y_lag1, 1e-9) AS mu FROM f UNION ALL SELECT year, 'moving_rate', y, 0.1e0 + count_roll12/12e0 FROM f)"""


@query(
    "walk_forward_naive",
    f"""WITH {_WF} SELECT year, model, count(*)::BIGINT AS n, round(avg(abs(y - mu)), 6) AS mae, round(sqrt(avg((y - mu)**2)), 6) AS rmse, round(avg({sql.DEVIANCE}), 6) AS mpd
      FROM m GROUP BY ALL""",
)
def walk_forward_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.walk_forward_naive(panel(spark, sf_dir, "orders"), (1998, 1999, 2000, 2001)).select("year", "model", "n", *r6("mae", "rmse", "mpd"))


@query(
    "a25_average_improvement",
    f"""WITH {_WF}, g AS (SELECT year, model, avg({sql.DEVIANCE}) AS d FROM m GROUP BY ALL)
      SELECT round(100e0*(avg(d) FILTER (model = 'naive') - avg(d) FILTER (model = 'moving_rate'))/avg(d) FILTER (model = 'naive'), 6) AS improvement_pct FROM g""",
)
def a25_average_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.walk_forward_naive(panel(spark, sf_dir, "orders"), (1998, 1999, 2000, 2001)).withColumnRenamed("mpd", "mean_poisson_deviance")
    return V.average_improvement(rows, "naive", "moving_rate").select(*r6("improvement_pct"))


@query("walk_forward")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.walk_forward(panel(spark, sf_dir, "orders"), binned(spark, sf_dir, "orders"), (1998, 1999, 2000, 2001), 7.0)


@query("v6_improvements")
def v6_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each walk-forward model's mean deviance lies below the regression's."""
    return V.improvements(walk_forward(spark, sf_dir))


@query("k3_study_results")
def k3_study_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve tables of the orders catalogue, written to the shared folder."""
    folder = f"{shared_folder(spark)}/study-{uuid.uuid4().hex}"
    kind = "orders"
    return study.run(stage(READ[kind](spark, sf_dir)), stage(binned(spark, sf_dir, kind)), panel(spark, sf_dir, kind), folder, (1998, 1999, 2000, 2001))


@query(
    "k4_stored_upsert",
    f"""WITH {sql.binned('orders')}, a AS (SELECT cell_id, year(week) AS year, count(*)::BIGINT AS n FROM binned WHERE year(week) < 1998 GROUP BY ALL),
      b AS (SELECT cell_id, year(week) AS year, count(*)::BIGINT AS n, round(max(mag), 6) AS top FROM binned WHERE year(week) >= 1996 GROUP BY ALL)
      SELECT cell_id, year, n, NULL::DOUBLE AS top FROM a WHERE NOT EXISTS (FROM b WHERE b.cell_id = a.cell_id AND b.year = a.year) UNION ALL SELECT cell_id, year, n, top FROM b""",
)
def k4_stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly counts by cell, stored up to 1997, then replaced and added to from 1996 on."""
    folder = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rows = binned(spark, sf_dir, "orders").withColumn("year", F.year("week").cast("long"))
    counts = rows.groupBy("cell_id", "year")
    keyed.upsert(counts.agg(F.count(F.lit(1)).alias("n")).where("year < 1998"), folder, ["cell_id", "year"])
    keyed.upsert(counts.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("mag"), 6).alias("top")).where("year >= 1996"), folder, ["cell_id", "year"])
    return keyed.read(spark, folder)
