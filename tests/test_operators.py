"""Kernels, recovery of known parameters, invariants and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.functions import dist
from tesseral.config import ALPHA_GRID
from tesseral.functions import grid as G
from tesseral.operators import etas, evaluation, glm, ingest, mlp, panel, splits, stats
from tesseral.plans.registry import QUERIES


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, time string, latitude double, longitude double, mag double").withColumn(
        "time", F.to_timestamp_ntz("time")
    )


def test_future_events_change_no_feature(spark):
    rows = [(i, f"2020-{1 + i % 12:02d}-{1 + i % 28:02d} 10:00:00", 39.0 + 3 * (i % 2), 66.0, 3.0 + (i % 30) / 10) for i in range(120)]
    before = panel.build_panel(events(spark, rows))
    after = panel.build_panel(events(spark, [*rows, (999, "2020-12-28 09:00:00", 39.0, 66.0, 7.0)]))
    cut = F.col("week") < F.lit("2020-12-28").cast("timestamp_ntz")
    names = [c for c in before.columns]
    assert sorted(map(tuple, before.where(cut).select(*names).collect())) == sorted(map(tuple, after.where(cut).select(*names).collect()))


def test_events_without_place_or_none_at_all(spark):
    rows = [(1, "2020-01-06 00:00:00", 40.0, 70.0, 3.0), (2, "2020-01-06 00:00:00", None, 70.0, 3.0), (3, "2020-02-06 00:00:00", 40.0, 70.0, None)]
    base = panel.dense_base(panel.aggregate_cells(panel.bin_events(events(spark, rows))))
    assert base.agg(F.sum("y"), F.count("*")).head()[:] == (1, 5)
    empty = events(spark, rows).where("event_id < 0")
    assert panel.build_panel(empty).count() == 0
    assert stats.completeness(empty).count() == 0


def test_on_edge_coordinates_and_half_even_rounding(spark):
    df = spark.createDataFrame([(41.0, 68.0), (40.999999, 67.999999), (38.0, 65.0)], "a double, b double")
    keys = [r[0] for r in df.select(G.cell_key(G.grid_floor(F.col("a"), 38.0, 3.0), G.grid_floor(F.col("b"), 65.0, 3.0))).collect()]
    assert keys == ["41.00_68.00", "38.00_65.00", "38.00_65.00"]


def test_ingest_errors(spark):
    with pytest.raises(ValueError, match="missing columns"):
        ingest.clean_catalogue(spark.createDataFrame([("x",)], "time string"))
    bad = spark.createDataFrame([("not a time", "1", "2", "3", "4", "p")], "time string, latitude string, longitude string, depth string, mag string, place string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        ingest.clean_catalogue(bad).collect()
    out = events(spark, [(1, "2020-01-06 00:00:00", 10.0, 70.0, 3.0)])
    with pytest.raises(ValueError, match="out of bounds"):
        ingest.validate(out)
    with pytest.raises(ValueError, match="no events"):
        ingest.validate(out.where("event_id < 0"))


def test_distributions_equal_direct_sums(spark):
    cases = [("nb", 0, 0.3, 0.5), ("nb", 7, 4.2, 1.7), ("poisson", 0, 0.1, None), ("poisson", 9, 6.5, None), ("poisson", 800, 790.0, None)]
    df = spark.createDataFrame(cases, "family string, y long, mu double, alpha double")
    got = df.select(dist.cdf(F.col("family"), F.col("y"), F.col("mu"), F.col("alpha")).alias("c"), dist.crps(F.col("family"), F.col("y"), F.col("mu"), F.col("alpha"), F.lit(40)).alias("s")).collect()

    def pmf(family, k, mu, alpha):
        if family == "poisson":
            return math.exp(k * math.log(mu) - mu - math.lgamma(k + 1))
        r = 1 / alpha
        return math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) - r * math.log1p(alpha * mu) + k * math.log(alpha * mu / (1 + alpha * mu)))

    for (family, y, mu, alpha), row in zip(cases, got, strict=True):
        f = np.cumsum([pmf(family, k, mu, alpha) for k in range(max(y, 40) + 1)])
        assert row.c == pytest.approx(f[y], abs=1e-9)
        assert row.s == pytest.approx(sum((f[k] - (y <= k)) ** 2 for k in range(41)), abs=1e-9)


def test_regressions_recover_their_coefficients(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    mu = np.exp(0.5 + x @ [0.4, -0.3])
    y = rng.poisson(rng.gamma(2.0, mu / 2.0))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y long")
    poisson, nb = glm.fit_poisson(df, ("a", "b")), glm.fit_nb(df, ("a", "b"), grid=(0.05, 0.2, 0.5, 1.0, 2.0))
    assert np.allclose(poisson.beta, [0.5, 0.4, -0.3], atol=0.08) and np.allclose(nb.beta, [0.5, 0.4, -0.3], atol=0.08)
    assert nb.alpha == 0.5
    test = glm.overdispersion_test(poisson, nb)
    assert test["lr_stat"] > 100 and test["p_value_boundary"] < 1e-6


def test_network_gradients():
    rng = np.random.default_rng(0)
    w = mlp.init(3, 4, 1)
    x, cell, y = rng.normal(size=(6, 4)), np.array([0, 1, 2, 3, 0, 1]), np.array([0.0, 1, 2, 5, 3, 0])
    for kind in ("nb", "poisson"):
        mu, alpha, kept = mlp.forward(w, x, cell)
        _, a, b = mlp.loss_and_slopes(kind, mu, alpha, y)
        grads = mlp.backward(w, cell, kept, a, b)
        for k in w:
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            low, high = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            low[k][at] -= 1e-6
            high[k][at] += 1e-6
            f = lambda v: mlp.loss_and_slopes(kind, *mlp.forward(v, x, cell)[:2], y)[0]  # noqa: B023, E731
            assert (f(high) - f(low)) / 2e-6 == pytest.approx(grads[k][at], abs=1e-6)


def test_point_process_gradient_and_fit():
    rng = np.random.default_rng(2)
    t, m = np.sort(rng.uniform(0, 50, 60)), 3 + rng.exponential(0.4, 60)
    p = np.array([0.5, 0.2, 0.05, 1.3, 0.9])
    value, grad = etas.nll_and_gradient(p, t, m)
    for k in range(5):
        d = np.zeros(5)
        d[k] = 1e-6
        assert (etas.nll_and_gradient(p + d, t, m)[0] - etas.nll_and_gradient(p - d, t, m)[0]) / 2e-6 == pytest.approx(grad[k], rel=1e-4, abs=1e-4)
    fit = etas.fit_cell("x", t, m, 50.0)
    assert not fit["fallback"] and fit["nll"] <= value
    assert etas.fit_cell("x", t[:3], m[:3], 50.0)["mu"] == pytest.approx(3 / 50)


def test_split_and_encoding_edges(spark):
    rows = spark.createDataFrame([("a", "2020-01-06", 1), ("a", "2020-01-13", 2), ("b", "2020-01-13", 0)], "cell_id string, week string, y long").withColumn(
        "week", F.to_timestamp_ntz("week")
    )
    assert splits.split_by_week(rows).where("is_test").count() == 2
    coded = splits.encode_cells(rows.where("cell_id = 'a'"), rows).select("cell_id", "cell_idx").distinct().collect()
    assert {r.cell_id: r.cell_idx for r in coded} == {"a": 0, "b": 1}
    constant = splits.fit_scaler(rows.withColumn("k", F.lit(2.0)), ("k",)).head()
    assert (constant["mean"], constant["scale"]) == (2.0, 1.0)


def test_registered_fits_have_full_settings(spark, sf_dir, monkeypatch):
    seen = {}

    class Stop(BaseException):  # as models that fail with an Exception are rows
        pass

    def note(name, value):
        seen[name] = value
        raise Stop

    monkeypatch.setattr(mlp, "train_and_score", lambda rows, jobs, how: note("how", how))
    monkeypatch.setattr(glm, "fit_nb", lambda t, c, grid=ALPHA_GRID: note("grid", grid))
    for name in ("g17_network_ablation", "g18_identifiability"):
        with pytest.raises(Stop):
            QUERIES[name](spark, sf_dir)
        assert seen.pop("how") == mlp.Training() and mlp.Training().epochs == 100 and mlp.Training().patience == 10
    for name in ("g6_classical_models", "m17_overdispersion_test"):
        with pytest.raises(Stop):
            QUERIES[name](spark, sf_dir)
        assert seen.pop("grid") == ALPHA_GRID
    monkeypatch.setattr(evaluation, "walk_forward", lambda p, b, years, days, grid=ALPHA_GRID: (years, grid))
    assert QUERIES["walk_forward"](spark, sf_dir) == ((1998, 1999, 2000, 2001), ALPHA_GRID)


def test_likelihood_of_all_events(spark, sf_dir):
    from tesseral.plans import model_queries as Q

    times = etas.event_times(Q.binned(spark, sf_dir, "bursty"))
    want = {r.cell_id: r.nll for r in etas.likelihood_table(times, Q._fixed(times)).collect()}
    got = {r.cell_id: r.nll for r in QUERIES["g19_etas_likelihood_bursty"](spark, sf_dir).collect()}
    assert len(got) == 21 and got == pytest.approx(want, abs=1e-4)
    # Repeated times and magnitudes, and more events than a block holds.
    rng = np.random.default_rng(3)
    rows = [("x", float(t), 3.0 + float(m)) for t, m in zip(np.sort(rng.integers(0, 90, 600)), rng.integers(0, 4, 600), strict=True)] + [("y", 0.0, 3.5)]
    times = spark.createDataFrame(rows, "cell_id string, t_days double, mag double")
    want = {r.cell_id: r.nll for r in etas.likelihood_table(times, Q._fixed(times)).collect()}
    assert {r.cell_id: r.nll for r in etas.likelihood(times, Q._fixed(times)).collect()} == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_unfinished_point_process_falls_back(monkeypatch):
    rng = np.random.default_rng(2)
    t, m = np.sort(rng.uniform(0, 50, 60)), 3 + rng.exponential(0.4, 60)
    assert etas.MAX_ITERATIONS == 500 and not etas.fit_cell("x", t, m, 50.0)["fallback"]
    monkeypatch.setattr(etas, "MAX_ITERATIONS", 1)
    fit = etas.fit_cell("x", t, m, 50.0)
    assert fit["fallback"] and fit["k"] == 0.0 and fit["mu"] == pytest.approx(59 / (t[-1] - t[0]))


def test_cutoff_of_the_calendar_is_that_of_the_panel(spark, sf_dir):
    from tesseral.plans import panel_queries as P

    for kind in ("orders", "bursty"):
        assert splits.week_cutoff(P.panel(spark, sf_dir, kind)).head() == P.cutoff(spark, sf_dir, kind).head()


def _design(spark, sf_dir, kind):
    from tesseral.config import ENHANCED_FEATURES
    from tesseral.plans import panel_queries as P

    train, _ = evaluation.scaled_split(P.panel(spark, sf_dir, kind), ENHANCED_FEATURES)
    rows = train.select("y", *ENHANCED_FEATURES).toPandas()
    return np.column_stack([np.ones(len(rows)), rows[list(ENHANCED_FEATURES)]]), rows["y"].to_numpy(float)


def test_poisson_fit_solves_the_score_equations(spark, sf_dir):
    x, y = _design(spark, sf_dir, "orders")
    rows = QUERIES["g2_poisson_fit"](spark, sf_dir).collect()
    mu = np.exp(x @ np.array([r.beta for r in rows]))
    assert np.abs(x.T @ (y - mu)).max() < 1e-3 * len(y)
    assert rows[0].llf == pytest.approx((y * np.log(mu) - mu - [math.lgamma(v + 1) for v in y]).sum(), rel=1e-5)


def test_nb_profile_equals_newton_steps(spark, sf_dir):
    x, y = _design(spark, sf_dir, "bursty")
    rows = QUERIES["g4_nb_profile"](spark, sf_dir).collect()
    assert len(rows) == 60 and sum(r.is_best for r in rows) == 1
    for r in [*rows[::12], *(r for r in rows if r.is_best)]:
        a, beta = r.alpha, np.r_[math.log(y.mean()), np.zeros(x.shape[1] - 1)]
        for _ in range(200):
            mu = np.exp(np.clip(x @ beta, -30, 30))
            w = mu / (1 + a * mu)
            step = np.linalg.lstsq((x * w[:, None]).T @ x + 1e-10 * np.eye(x.shape[1]), x.T @ ((y - mu) / (1 + a * mu)), rcond=None)[0]
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
        mu = np.exp(x @ beta)
        ll = sum(math.lgamma(v + 1 / a) - math.lgamma(1 / a) - math.lgamma(v + 1) + v * math.log(a * m / (1 + a * m)) - math.log1p(a * m) / a for v, m in zip(y, mu, strict=True))
        assert r.llf == pytest.approx(ll, rel=1e-5), r
    assert max(rows, key=lambda r: r.llf).is_best


def test_permutations_of_a_small_lattice(spark):
    import itertools

    cells = spark.createDataFrame([(f"c{a}{b}", 3.0 * a, 3.0 * b) for a in range(2) for b in range(3)], "cell_id string, lat_grid double, lon_grid double")
    x = {"c00": 1.0, "c01": 0.8, "c02": -0.5, "c10": 1.2, "c11": 0.1, "c12": -2.0}
    values = spark.createDataFrame([("m", c, v) for c, v in x.items()], "model string, cell_id string, x double")
    weights = evaluation.spatial.queen_weights(cells)
    w = {(r.cell_i, r.cell_j): r.w for r in weights.collect()}

    def moran(v):
        d = {c: a - np.mean(list(v.values())) for c, a in v.items()}
        return len(v) * sum(k * d[i] * d[j] for (i, j), k in w.items()) / (sum(w.values()) * sum(a * a for a in d.values()))

    seen = moran(x)
    drawn = [moran(dict(zip(x, p, strict=True))) for p in itertools.permutations(x.values())]
    got = evaluation.spatial.permutation_test(values, weights, 3000).head()
    assert got.moran_i == pytest.approx(seen) == evaluation.spatial.morans_i(values, weights).head().moran_i
    assert got.p_perm == pytest.approx(np.mean(np.array(drawn) >= seen - 1e-12), abs=0.03) and got.z_score == pytest.approx((seen - np.mean(drawn)) / np.std(drawn), abs=0.1)


def test_permutations_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    cells = spark.createDataFrame([(f"c{a}-{b}", 3.0 * a, 3.0 * b) for a in range(7) for b in range(5)], "cell_id string, lat_grid double, lon_grid double")
    values = spark.createDataFrame([(m, f"c{a}-{b}", float((a * a + 3 * b) % 7) + (m == "n") * a) for m in "mn" for a in range(7) for b in range(5)], "model string, cell_id string, x double")
    weights = evaluation.spatial.queen_weights(cells)
    found = []
    for parts, most in ((1, 4_000_000), (8, 4_000_000), (8, 0)):  # the last: joins instead of values in all tasks
        monkeypatch.setattr(evaluation.spatial, "MAX_VALUES", most)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = evaluation.spatial.permutation_test(values, weights, 120).orderBy("model").collect()
        found.append([(r.model, round(r.moran_i, 9), round(r.z_score, 9), r.p_perm) for r in got])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2] and len(found[0]) == 2
    flat = values.withColumn("x", F.lit(1.0))
    assert [(r.moran_i, r.z_score, r.p_perm) for r in evaluation.spatial.permutation_test(flat, weights, 20).collect()] == [(None, None, None)] * 2


@pytest.mark.parametrize("n", [1, 2, 6, 37, 1000])
@pytest.mark.parametrize("small", [0, 1 << 14])
def test_places_are_permutations(n, small, monkeypatch):
    from tesseral.functions import counter
    from tesseral.functions.counter import places

    monkeypatch.setattr(counter, "SMALL", small)
    rows = np.arange(n)
    first = places(rows, n, 1, 0)
    assert sorted(first) == list(range(n))
    assert (np.concatenate([places(rows[: n // 2], n, 1, 0), places(rows[n // 2 :], n, 1, 0)]) == first).all()
    assert n < 30 or (places(rows, n, 1, 1) != first).any()


def _training_rows(spark, n_weeks=30):
    import datetime as dt

    rng = np.random.default_rng(5)
    rows = [
        (f"c{c}", dt.datetime(2020, 1, 6) + dt.timedelta(weeks=w), int(rng.poisson(1 + c)), float(rng.normal()), float(rng.normal()), w >= 24)
        for w in range(n_weeks) for c in range(6)
    ]
    return spark.createDataFrame(rows, "cell_id string, week timestamp_ntz, y long, f1 double, f2 double, is_test boolean")


def test_parallel_training_walks_the_path_of_one_task(spark):
    rows = _training_rows(spark)
    jobs = [("a", "nb", ("f1", "f2"), 1), ("b", "poisson", ("f2",), 2)]
    how = mlp.Training(epochs=3, batch=16)
    key = lambda r: (r.job, r.cell_id, r.week)
    one = sorted(mlp.train_and_score(rows, jobs, how).collect(), key=key)
    assert len(one) == 2 * 6 * 6
    for tasks in (1, 3):
        many = sorted(mlp.train_parallel(rows, jobs, how, tasks=tasks).collect(), key=key)
        assert list(map(key, many)) == list(map(key, one)) and [r.y for r in many] == [r.y for r in one]
        for name in ("mu", "alpha", "val_loss"):
            assert np.allclose([r[name] for r in many], [r[name] for r in one], rtol=1e-9, atol=1e-9)


def test_large_folds_train_in_parallel(spark):
    rows = splits.year_folds(_training_rows(spark, 80).drop("is_test"), (2020, 2021)).withColumn("is_test", F.col("week") >= F.to_timestamp_ntz(F.lit("2021-03-01")))
    rows = rows.where("fold = 2021 OR NOT is_test").withColumn("is_test", F.col("is_test") | ((F.col("fold") == 2020) & (F.month("week") > 10)))
    jobs, how = [("a", "nb", ("f1", "f2"), 1)], mlp.Training(epochs=2, batch=32)
    small = {(r.job, r.cell_id, r.week): r.mu for r in mlp.train_and_score(rows, jobs, how).collect()}
    mixed = {(r.job, r.cell_id, r.week): r.mu for r in mlp.train_and_score(rows, jobs, how, most=400).collect()}
    assert set(small) == set(mixed) and {k[0] for k in small} == {"a:2020", "a:2021"}
    assert all(mixed[k] == pytest.approx(v, rel=1e-9) for k, v in small.items())


def test_a_model_that_fails_is_a_row(spark, monkeypatch):
    rows = _training_rows(spark)
    jobs = [("good", "nb", ("f1", "f2"), 1), ("bad", "nb", ("f1", "missing"), 1)]
    how = mlp.Training(epochs=1)
    got = mlp.train_and_score(rows, jobs, how)
    bad = got.where("error IS NOT NULL").collect()
    assert [(r.job, r.mu, r.cell_id) for r in bad] == [("bad", None, None)] and "missing" in bad[0].error
    assert got.where("error IS NULL").select("job").distinct().collect()[0].job == "good"
    named = got.select(F.col("job").alias("model"), F.lit("nb").alias("family"), "alpha", "y", "mu", "error")
    table = {r.model: r for r in evaluation.network_comparison(named).collect()}
    assert table["bad"].mae is None and table["bad"].status.startswith("FAILED") and table["good"].status == "OK" and table["good"].mae > 0


def test_walk_forward_goes_on_where_models_fail(spark, monkeypatch):
    def broken(*a, **k):
        raise RuntimeError("no fit")

    rows = _training_rows(spark, 80).drop("is_test")
    monkeypatch.setattr(evaluation, "ENHANCED_FEATURES", ("f1", "f2"))
    monkeypatch.setattr(evaluation.etas, "fit_cells", broken)
    binned = spark.createDataFrame([("c0", 3.5)], "cell_id string, mag double").withColumn("time", F.to_timestamp_ntz(F.lit("2020-02-03")))
    got = evaluation.walk_forward(rows, binned, (2021,), 7.0, grid=(0.5,), how=mlp.Training(epochs=1)).collect()
    assert {(r.year, r.model): r.status for r in got} == {
        (2021, "NB_Enhanced"): "OK", (2021, "ETAS"): "FAILED: RuntimeError", (2021, "Hybrid_NB"): "OK", (2021, "Neural_Poisson"): "OK"
    }
    assert all((r.mae is None) == (r.status != "OK") for r in got)
    without = evaluation.walk_forward(rows, None, (2021,), 7.0, grid=(0.5,), how=mlp.Training(epochs=1)).collect()
    assert {r.model for r in without} == {"NB_Enhanced", "Hybrid_NB", "Neural_Poisson"}


def test_times_of_mixed_forms(spark):
    forms = {
        "2020-01-06 01:02:03": "2020-01-06T01:02:03", "2020-01-06T01:02:03Z": "2020-01-06T01:02:03", "2020-01-06T01:02:03.500+02:00": "2020-01-05T23:02:03.500000",
        "2020/01/06 01:02:03": "2020-01-06T01:02:03", "06-01-2020 01:02:03": "2020-01-06T01:02:03", "2020-01-06": "2020-01-06T00:00:00", "never": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in forms], "t string").withColumn("u", ingest.naive_utc(F.col("t")))
    assert {r.t: r.u and r.u.isoformat() for r in df.collect()} == forms


def test_missing_columns_give_an_empty_table(spark):
    df = spark.range(2)
    assert ingest.or_empty(df, ("id",), "x int") is df
    with pytest.warns(UserWarning, match="missing"):
        assert ingest.or_empty(df, ("id", "y"), "x int").columns == ["x"]
    with pytest.raises(ValueError, match="negative"):
        ingest.validate_panel(spark.createDataFrame([(-1,)], "y long"))


def test_comparison_and_result_tables(spark, tmp_path):
    from tesseral.sources import catalogue

    rows = [("n", "nb", 2.0, "a", 1, 2, 1.5), ("n", "nb", 4.0, "a", 2, 1, 1.0), ("p", "poisson", None, "a", 1, 0, 0.5)]
    preds = spark.createDataFrame(rows, "model string, family string, alpha double, cell_id string, week int, y int, mu double")
    new = evaluation.network_comparison(preds)
    old = spark.createDataFrame([("n", "nb", 9.0, None), ("z", "x", 1.0, 2.0)], "model string, model_type string, mae double, rmse double")
    done = evaluation.final_comparison(ingest.upsert(old, new, "model").drop("rmse"))
    assert done.columns == ["model", "model_type", "mae", "mean_poisson_deviance", "alpha_hat", "status"]
    assert [(r.model, r.mae, r.alpha_hat) for r in done.collect()] == [("n", 0.25, 3.0), ("p", 0.5, None), ("z", 1.0, None)]
    assert catalogue.write_results({"comparison": done}, str(tmp_path)) == ["comparison"]
    assert spark.read.parquet(f"{tmp_path}/comparison").count() == 3
    with pytest.raises(ValueError, match="no such"):
        catalogue.write_results({"other": done}, str(tmp_path))


def test_dropout_is_on_both_layers():
    w = mlp.init(3, 2, 0)
    x, cell = np.ones((400, 2)), np.zeros(400, dtype=int)
    rows = np.arange(400)
    _, _, (_, m0, h1, m1, h2, _) = mlp.forward(w, x, cell, lambda units, layer: mlp.kept_units(rows, units, 0, 0, layer))
    _, _, (_, p0, _, p1, _, _) = mlp.forward(w, x, cell)
    for dropped, plain in ((m0, p0), (m1, p1)):
        assert 0 < (dropped[plain > 0] == 0).mean() < 0.5 or not plain.any()


def test_forecast_in_slices_equals_plain_sums(spark, monkeypatch):
    import datetime as dt

    rng = np.random.default_rng(4)
    origin, day = dt.datetime(2020, 1, 6), dt.timedelta(days=1)
    # Times before and within the weeks, repeated events, and a cell without events or without parameters.
    events = [("hot", float(t), 3.0 + float(m)) for t, m in zip(rng.integers(0, 40, 300), rng.integers(0, 3, 300), strict=True)] + [("one", 0.0, 4.0), ("unseen", 1.0, 3.0)]
    times = spark.createDataFrame([(*e, origin) for e in events], "cell_id string, t_days double, mag double, origin timestamp_ntz")
    given = {"hot": (0.5, 0.2, 0.05, 1.2, 0.8), "one": (0.1, 0.3, 0.01, 1.0, 0.5), "calm": (0.2, 0.0, 0.01, 1.1, 1.0)}
    params = spark.createDataFrame([(c, *v) for c, v in given.items()], "cell_id string, mu double, k double, c double, p double, a double")
    weeks = [(c, 7.0 * k) for c in ("hot", "one", "calm", "unseen") for k in (2, 5, 9)]
    asked = spark.createDataFrame([(c, origin + s * day) for c, s in [*weeks, weeks[0]]], "cell_id string, week timestamp_ntz")

    def want(cell, s):
        if cell not in given:
            return etas.UNSEEN_RATE
        mu, k, c, p, a = given[cell]
        total = mu * 7
        for x, t, m in events:
            d0, d1 = max(s, t) - t + c, s + 7 - t + c
            if x == cell and max(s, t) < s + 7:
                total += k * math.exp(a * (m - etas.M_C)) * (math.log(d1 / d0) if p == 1 else (d1 ** (1 - p) - d0 ** (1 - p)) / (1 - p))
        return total

    for size in (etas.SLICE, 7):
        monkeypatch.setattr(etas, "SLICE", size)
        got = {(r.cell_id, (r.week - origin) / day): r.lambda_pred for r in etas.forecast(asked, times, params).collect()}
        assert got == pytest.approx({w: want(*w) for w in weeks})
