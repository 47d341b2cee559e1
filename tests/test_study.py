"""The driver of all result tables: its figures recomputed from what it stored."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.operators import etas, evaluation, mlp
from tesseral.plans import model_queries as Q, study
from tesseral.sources import keyed
from tesseral.sources.catalogue import RESULTS
from tesseral.sources.staging import stage


def _deviance(y, mu, eps=0.0):
    return float(np.mean(2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / mu + eps), 0.0) - y + mu)))


def test_tables_of_a_study(spark, sf_dir, tmp_path):
    rows, at = stage(Q.panel(spark, sf_dir, "orders")), f"{tmp_path}/study"
    binned = stage(Q.binned(spark, sf_dir, "orders"))
    few = mlp.Training(epochs=2)
    report = study.run(binned, binned, rows, at, (2000, 2001), grid=(0.1, 0.5), how=few, folds=few, seeds=(1, 2)).collect()
    assert {r.result: r.status for r in report} == dict.fromkeys(RESULTS, "OK")
    compared = {r.model: r for r in keyed.read(spark, f"{at}/comparison").collect()}
    stored = spark.read.parquet(f"{at}/test_predictions").unionByName(spark.read.parquet(f"{at}/calibration_predictions").where("model != 'NB_Enhanced'")).toPandas()
    tail = {r.model: r for r in spark.read.parquet(f"{at}/tail_evaluation").where("stratum = 'All'").collect()}
    assert len(compared) == 10 and set(stored["model"]) == set(tail) == set(compared) - {"ETAS_Per_Cell"}
    for model, mine in stored.groupby("model"):
        y, mu, row = mine["y"].to_numpy(float), mine["mu"].to_numpy(), compared[model]
        assert row.status == "OK"
        assert (row.mae, row.rmse) == pytest.approx((np.abs(y - mu).mean(), math.sqrt(((y - mu) ** 2).mean())), rel=1e-9)
        assert row.mean_poisson_deviance == pytest.approx(_deviance(y, mu), rel=1e-9) and tail[model].mae == pytest.approx(row.mae, rel=1e-9)
    test = spark.read.parquet(f"{at}/overdispersion_test").head()
    assert test.lr_stat == pytest.approx(max(0.0, 2 * (test.ll_nb - test.ll_poisson))) and test.p_value_chi2 == pytest.approx(math.erfc(math.sqrt(test.lr_stat / 2)))
    assert test.alpha_hat_grid == compared["NB_Enhanced"].alpha_hat
    # One residual a cell and model: as many models as predictions have, and z and p of a permutation test.
    spatial = spark.read.parquet(f"{at}/spatial_diagnostics").collect()
    assert {r.model for r in spatial} == set(tail) and all(0 < r.p_perm <= 1 and r.significant == (r.p_perm < 0.05) for r in spatial)
    pits = {r.model: r for r in spark.read.parquet(f"{at}/calibration").collect()}
    assert set(pits) == set(tail) and all(0 < r.pit_mean < 1 for r in pits.values())
    folds = {(r.year, r.model): r for r in spark.read.parquet(f"{at}/walk_forward").collect()}
    assert len(folds) == 8 and all(r.status == "OK" for r in folds.values())


def test_a_point_process_that_fails_is_a_row_of_the_comparison(spark, sf_dir, tmp_path, monkeypatch):
    def broken(*a, **k):
        raise RuntimeError("no fit")

    rows = stage(Q.panel(spark, sf_dir, "orders"))
    monkeypatch.setattr(evaluation, "classical_models", lambda p, g: (spark.createDataFrame([("Naive", "Baseline", 1.0, 1.0, 1.0, None, "OK")], evaluation.COMPARISON), {}))
    monkeypatch.setattr(evaluation, "etas_static", broken)
    study.static_models(rows, rows, f"{tmp_path}/s", 7.0, (0.5,), mlp.Training(epochs=1), 3.0)
    got = {r.model: r.status for r in keyed.read(spark, f"{tmp_path}/s/comparison").collect()}
    assert got["ETAS_Per_Cell"] == "FAILED: RuntimeError" and got["Naive"] == "OK" and len(got) == 6


def test_point_process_fits_are_minima(spark, sf_dir):
    times = stage(etas.event_times(Q.binned(spark, sf_dir, "bursty")))
    fits = stage(etas.fit_cells(times))
    found = fits.where("NOT fallback")
    again = {r.cell_id: r.nll for r in etas.likelihood_table(times, found).collect()}
    events = {k: v for k, v in times.toPandas().sort_values(["t_days", "mag"]).groupby("cell_id")}
    rows = found.collect()
    assert len(rows) > 10
    for r in rows:
        p = np.array([r.mu, r.k, r.c, r.p, r.a])
        value, slopes = etas.nll_and_gradient(p, events[r.cell_id]["t_days"].to_numpy(), events[r.cell_id]["mag"].to_numpy())
        assert r.nll == pytest.approx(value, abs=1e-6) == pytest.approx(again[r.cell_id], abs=1e-4)
        free = ~(((p <= etas.LOW * (1 + 1e-9)) & (slopes > 0)) | ((p >= etas.HIGH * (1 - 1e-9)) & (slopes < 0)))
        assert np.abs((slopes * p)[free]).max(initial=0.0) < 1e-2 * (1 + abs(value))
    # An audit of stored forecasts at the fits: every test week of every cell has one.
    weeks = Q.panel(spark, sf_dir, "bursty").select("cell_id", "week").where(F.hour("week") < 2)
    assert etas.forecast(weeks, times, fits).where("lambda_pred > 0").count() == weeks.distinct().count()
