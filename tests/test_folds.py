"""Fits of all folds in the same passes, against the loop over folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.operators import evaluation, glm, mlp, splits

YEARS, COLUMNS, GRID = (2019, 2020, 2021), ("f1", "f2"), (0.1, 0.5, 1.0)


def _panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for year in (2018, *YEARS):
        for i in range(60):
            f1, f2 = float(rng.normal(year - 2018, 1)), float(rng.integers(0, 4))
            rows.append((f"c{i % 5}", f"{year}-{1 + i // 5:02d}-04", f1, f2, 7.0, int(rng.negative_binomial(2, 2 / (2 + np.exp(0.2 + 0.3 * f1 - 0.2 * f2))))))
    return spark.createDataFrame(rows, "cell_id string, week string, f1 double, f2 double, k double, y long").withColumn("week", F.to_timestamp_ntz("week"))


def test_folds_fit_as_in_a_loop_with_a_pass_a_round(spark, monkeypatch):
    rows, passes, once = _panel(spark), [], glm._sums
    monkeypatch.setattr(glm, "_sums", lambda *a: passes.append(len(a[2])) or once(*a))
    folds = splits.scale_folds(splits.year_folds(rows, YEARS), COLUMNS)
    got = glm.fit_nb_groups(folds.where("NOT is_test"), COLUMNS, "fold", grid=GRID)
    together = len(passes)
    mu = {(r.fold, r.cell_id, r.week): r.mu for r in glm.predict_groups(folds.where("is_test"), "fold", COLUMNS, got).collect()}
    # One pass holds all folds and dispersions.
    assert passes[0] == len(YEARS) and max(passes) == len(YEARS) * len(GRID)
    rounds = []
    for year in YEARS:
        passes.clear()
        fold = splits.year_folds(rows, (year,))
        train = fold.where("NOT is_test")
        scaled = splits.scale(fold, COLUMNS, splits.fit_scaler(train, COLUMNS))
        want = glm.fit_nb(scaled.where("NOT is_test"), COLUMNS, grid=GRID)
        rounds.append(len(passes))
        assert (got[year].alpha, got[year].converged) == (want.alpha, True)
        assert got[year].beta == pytest.approx(want.beta, rel=1e-9) and got[year].llf == pytest.approx(want.llf, rel=1e-9)
        for r in scaled.where("is_test").withColumn("mu", glm.predict(COLUMNS, want.beta)).collect():
            assert mu[year, r.cell_id, r.week] == pytest.approx(r.mu, rel=1e-9)
    assert together < sum(rounds)


def test_constant_features_and_folds_without_rows(spark):
    rows = _panel(spark)
    scaled = splits.scale_folds(splits.year_folds(rows, (2018, 2019)), ("k",))
    # 2018 has no train rows, so no scaler; 2019's constant becomes 0.
    assert {(r.fold, r.k) for r in scaled.collect()} == {(2019, 0.0)}


def test_a_fold_that_fails_costs_no_other(spark, monkeypatch):
    fit = glm.fit_nb_groups

    def broken(rows, columns, group, grid):
        if rows.where("fold = 2020").count():
            raise RuntimeError("no fit")
        return fit(rows, columns, group, grid=grid)

    monkeypatch.setattr(evaluation, "ENHANCED_FEATURES", COLUMNS)
    monkeypatch.setattr(evaluation.glm, "fit_nb_groups", broken)
    scores = evaluation.walk_forward(_panel(spark), None, (2017, *YEARS), 7.0, grid=GRID, how=mlp.Training(epochs=1)).where("model = 'NB_Enhanced'").collect()
    assert {r.year: r.status for r in scores} == {2019: "OK", 2020: "FAILED: RuntimeError", 2021: "OK"}
    assert all((r.mae is None) == (r.year == 2020) for r in scores)


def test_improvements_over_the_regression(spark):
    rows = [(2020, "NB_Enhanced", 2.0), (2021, "NB_Enhanced", 4.0), (2020, "ETAS", 1.5), (2021, "ETAS", None), (2020, "Hybrid_NB", None)]
    df = spark.createDataFrame(rows, "year int, model string, mean_poisson_deviance double")
    assert {r.model: r.improvement_pct for r in evaluation.improvements(df).collect()} == {"NB_Enhanced": 0.0, "ETAS": 50.0, "Hybrid_NB": None}
    assert {r.improvement_pct for r in evaluation.improvements(df.where("model != 'NB_Enhanced'")).collect()} == {None}


def test_fold_forecasts_read_fits_that_are_made_once(spark, monkeypatch):
    caught, once = [], evaluation.etas.forecast
    monkeypatch.setattr(evaluation, "ENHANCED_FEATURES", COLUMNS)
    monkeypatch.setattr(evaluation.etas, "forecast", lambda weeks, times, params, *a: caught.append(params) or once(weeks, times, params, *a))
    binned = _panel(spark).where("y > 0").select("cell_id", F.col("week").alias("time"), (3 + F.col("f2") / 4).alias("mag"))
    scores = evaluation.walk_forward(_panel(spark), binned, (2020, 2021), 7.0, grid=GRID, how=mlp.Training(epochs=1)).where("model = 'ETAS'").collect()
    assert {r.year: r.status for r in scores} == {2020: "OK", 2021: "OK"}
    assert [("FlatMapGroups" in p._jdf.queryExecution().toString()) for p in caught] == [False]


def test_predictions_of_any_size_are_whole(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in (-800, -40, 0, 29, 31, 70, 480)], "fold int, f1 double")
    want = [max(np.exp(x), 1e-9) for x in (-800, -40, 0, 29, 31, 70, 480)]
    alone = [r.mu for r in rows.withColumn("mu", glm.predict(("f1",), np.array([0.0, 1.0]))).orderBy("f1").collect()]
    fits = {1: glm.Fit(("f1",), np.array([0.0, 1.0]), 0.0)}
    by_fold = [r.mu for r in glm.predict_groups(rows, "fold", ("f1",), fits).orderBy("f1").collect()]
    assert alone == pytest.approx(want, rel=1e-12) and by_fold == pytest.approx(want, rel=1e-12)
