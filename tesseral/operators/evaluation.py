"""Model comparison, walk-forward evaluation and the self-exciting baseline's
static evaluation: tables in, tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.config import ALPHA_GRID, BASELINE_FEATURES, ENHANCED_FEATURES, FLOOR
from tesseral.functions.grid import finite
from tesseral.operators import etas, glm, metrics, mlp, spatial, splits
from tesseral.sources.staging import stage

COMPARISON = "model string, model_type string, mae double, rmse double, mean_poisson_deviance double, alpha_hat double, status string"


def log_energy(panel: DataFrame) -> DataFrame:
    """The panel with energy on a log scale, for those who want it: the models take the panel as it is."""
    return panel.withColumn("energy_roll8", F.log10(1 + F.col("energy_roll8")))


def scaled_split(panel: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with features standardised on the train rows."""
    rows = splits.split_by_week(panel)
    train = rows.where("NOT is_test")
    scaled = splits.scale(rows, columns, splits.fit_scaler(train, columns))
    return scaled.where("NOT is_test"), scaled.where("is_test")


def comparison_row(name: str, kind: str, scored: DataFrame, alpha: float | None) -> DataFrame:
    m = metrics.basic_metrics(scored)
    return m.select(
        F.lit(name).alias("model"), F.lit(kind).alias("model_type"), "mae", "rmse", F.col("mpd").alias("mean_poisson_deviance"),
        F.lit(alpha).cast("double").alias("alpha_hat"), F.lit("OK").alias("status"),
    )


def failed(spark: SparkSession, name: str, kind: str, why: Exception) -> DataFrame:
    return spark.createDataFrame([(name, kind, None, None, None, None, f"FAILED: {type(why).__name__}")], COMPARISON)


def classical_models(panel: DataFrame, grid: tuple[float, ...] = ALPHA_GRID) -> tuple[DataFrame, dict[str, glm.Fit]]:
    """Persistence, Poisson and NB regressions on both feature sets: one row per
    model, a failed one with nulls, and the fits."""
    spark, rows = panel.sparkSession, panel
    test = splits.split_by_week(rows).where("is_test")
    out = comparison_row("Naive", "Baseline", test.withColumn("mu", F.greatest("y_lag1", F.lit(FLOOR))), None)
    fits: dict[str, glm.Fit] = {}
    for label, columns in (("Baseline", BASELINE_FEATURES), ("Enhanced", ENHANCED_FEATURES)):
        train, held = scaled_split(rows, columns)
        for family, fit in (("Poisson", lambda t, c: glm.fit_poisson(t, c)), ("NB", lambda t, c: glm.fit_nb(t, c, grid=grid))):
            name = f"{family}_{label}"
            try:
                f = fits[name] = fit(train, columns)
                row = comparison_row(name, family, held.withColumn("mu", glm.predict(columns, f.beta)), f.alpha if family == "NB" else None)
            except Exception as why:  # noqa: BLE001 - a model that fails, in whatever way, is a row of its own
                row = failed(spark, name, family, why)
            out = out.unionByName(row)
    return out, fits


def classical_predictions(panel: DataFrame, fits: dict[str, glm.Fit]) -> DataFrame:
    """Test predictions of persistence and of classical_models()'s fits, as a long table."""
    held = splits.split_by_week(panel).where("is_test").withColumn("mu", F.greatest("y_lag1", F.lit(FLOOR)))
    named = lambda rows, name, alpha: rows.select(
        F.lit(name).alias("model"), F.lit("nb" if alpha else "poisson").alias("family"), F.lit(alpha).cast("double").alias("alpha"), "cell_id", "week", "y", "mu"
    )
    out = named(held, "Naive", None)
    for columns in dict.fromkeys(f.columns for f in fits.values()):
        scaled = scaled_split(panel, columns)[1]
        for name, f in fits.items():
            if f.columns == columns:
                out = out.unionByName(named(scaled.withColumn("mu", glm.predict(columns, f.beta)), name, f.alpha or None))
    return out


def lr_test(panel: DataFrame, grid: tuple[float, ...] = ALPHA_GRID) -> DataFrame:
    """Likelihood ratio of NB to Poisson on the enhanced features' train rows: one row."""
    train, _ = scaled_split(panel, ENHANCED_FEATURES)
    return overdispersion_row(panel.sparkSession, glm.fit_poisson(train, ENHANCED_FEATURES), glm.fit_nb(train, ENHANCED_FEATURES, grid=grid))


def overdispersion_row(spark: SparkSession, poisson: glm.Fit, nb: glm.Fit) -> DataFrame:
    """glm.overdispersion_test() as a table of one row."""
    row = glm.overdispersion_test(poisson, nb)
    kinds = {int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))


NETWORKS = (
    ("Hybrid_DL_NB_Baseline", "nb", BASELINE_FEATURES, 42),
    ("Hybrid_DL_NB_Enhanced", "nb", ENHANCED_FEATURES, 42),
    ("Neural_Poisson_Baseline", "poisson", BASELINE_FEATURES, 42),
    ("Neural_Poisson_Enhanced", "poisson", ENHANCED_FEATURES, 42),
)


def network_predictions(panel: DataFrame, jobs: tuple = NETWORKS, how: mlp.Training = mlp.Training()) -> DataFrame:
    """Test predictions of the networks, as a long table with alpha per row."""
    rows = splits.split_by_week(panel)
    out = mlp.train_and_score(rows, list(jobs), how)
    family = F.when(F.col("job").contains("Poisson"), "poisson").otherwise("nb")
    return out.select(F.col("job").alias("model"), family.alias("family"), "alpha", "cell_id", "week", "y", "mu", "error")


def network_comparison(predictions: DataFrame) -> DataFrame:
    """Rows of the model comparison for network_predictions(); a network that failed
    has nulls and its error as the status."""
    if "error" not in predictions.columns:
        predictions = predictions.withColumn("error", F.lit(None).cast("string"))
    bad = predictions.where("error IS NOT NULL")
    predictions = predictions.where("error IS NULL")
    m = metrics.basic_metrics(predictions, "model", "family")
    alpha = predictions.groupBy("model").agg(F.avg(F.when(F.col("family") == "nb", F.col("alpha"))).alias("alpha_hat"))
    done = m.join(alpha, "model").select(
        "model", F.col("family").alias("model_type"), "mae", "rmse", F.col("mpd").alias("mean_poisson_deviance"), "alpha_hat", F.lit("OK").alias("status")
    )
    nulls = (F.lit(None).cast("double").alias(c) for c in ("mae", "rmse", "mean_poisson_deviance", "alpha_hat"))
    return done.unionByName(bad.select("model", F.col("family").alias("model_type"), *nulls, F.concat(F.lit("FAILED: "), "error").alias("status")))


def final_comparison(rows: DataFrame) -> DataFrame:
    """The comparison's columns, of which only those that exist, by model."""
    return rows.select(*(c.split()[0] for c in COMPARISON.split(", ") if c.split()[0] in rows.columns)).orderBy("model")


def with_alpha(predictions: DataFrame, comparison: DataFrame, default: float | None = 1.0) -> DataFrame:
    """Predictions whose NB rows have the alpha that the comparison holds for
    their model, `default` where it holds none or no finite one."""
    known = comparison.where(finite(F.col("alpha_hat"))).groupBy("model").agg(F.first("alpha_hat").alias("alpha_hat"))
    alpha = F.when(F.col("family") == "nb", F.coalesce("alpha_hat", F.lit(default)))
    return predictions.join(known, "model", "left").withColumn("alpha", alpha.cast("double")).drop("alpha_hat")


def spatial_diagnostics(predictions: DataFrame, comparison: DataFrame, cells: DataFrame, runs: int = 999) -> DataFrame:
    """(model, moran_i, z_score, p_perm, significant) of every model's Pearson
    residuals, averaged by cell; alpha comes from the comparison by name."""
    residuals = metrics.pearson_residuals(with_alpha(predictions, comparison))
    found = spatial.permutation_test(spatial.cell_means(residuals, cells, "residual"), spatial.queen_weights(cells), runs)
    return found.withColumn("significant", F.col("p_perm") < 0.05)


def identifiability(panel: DataFrame, seeds: tuple[int, ...], how: mlp.Training = mlp.Training()) -> DataFrame:
    """Test alphas of the enhanced NB network by seed: (seed, alpha_pred, ..)."""
    rows = splits.split_by_week(panel)
    jobs = [(str(s), "nb", ENHANCED_FEATURES, s) for s in seeds]
    return mlp.train_and_score(rows, jobs, how).where("error IS NULL").select(F.col("job").cast("int").alias("seed"), F.col("alpha").alias("alpha_pred"), "cell_id", "week", "y", "mu")


def etas_static(binned: DataFrame, panel: DataFrame, days: float, m_c: float = etas.M_C) -> DataFrame:
    """(cell_id, week, y, mu): forecasts of the test weeks from the training events, over magnitude m_c."""
    cutoff = splits.week_cutoff(panel).head().cutoff
    times = stage(etas.event_times(binned, F.lit(cutoff)))
    params = stage(etas.fit_cells(times, m_c))
    test = splits.split_by_week(panel).where("is_test")
    pred = etas.forecast(test.select("cell_id", "week"), times, params, days, m_c)
    return test.join(pred, ["cell_id", "week"], "left").select(
        "cell_id", "week", "y", F.greatest(F.coalesce("lambda_pred", F.lit(etas.UNSEEN_RATE)), F.lit(FLOOR)).alias("mu")
    )


def walk_forward_naive(panel: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Persistence and the moving rate, by test year."""
    test = splits.year_folds(panel, years).where("is_test")
    both = F.array(
        F.struct(F.lit("naive").alias("model"), F.greatest("y_lag1", F.lit(FLOOR)).alias("mu")),
        F.struct(F.lit("moving_rate").alias("model"), (F.lit(0.1) + F.col("count_roll12") / 12).alias("mu")),
    )
    rows = test.select("fold", "y", F.explode(both).alias("p")).select(F.col("fold").alias("year"), "p.model", "y", "p.mu")
    return metrics.basic_metrics(rows, "year", "model")


FOLD_SCORES = "year int, model string, mae double, rmse double, mean_poisson_deviance double, alpha_hat double, status string"


def walk_forward(
    panel: DataFrame, binned: DataFrame | None, years: tuple[int, ...], days: float, grid: tuple[float, ...] = ALPHA_GRID, how: mlp.Training = mlp.WALK_FORWARD
) -> DataFrame:
    """NB regression, both networks and the self-exciting process by test year:
    FOLD_SCORES.  A model that fails in a fold is a row with nulls and its error,
    and the others go on; without binned events there is no self-exciting process.
    A model's folds are fitted together."""
    spark, rows = panel.sparkSession, stage(panel)
    there = splits.year_folds(rows, years).groupBy("fold").agg(F.bool_or("is_test").alias("test"), F.bool_or(~F.col("is_test")).alias("train"))
    whole = tuple(sorted(r.fold for r in there.where("test AND train").collect()))
    found: list[tuple] = []

    def add(name: str, score: Callable[[tuple[int, ...]], tuple[DataFrame, dict[int, float]]], asked: tuple[int, ...]) -> None:
        """All folds at once; where that fails, each by itself, so that one that fails costs no other."""
        try:
            scored, alpha = score(asked)
            for r in metrics.basic_metrics(scored, "fold").collect():
                found.append((r.fold, name, r.mae, r.rmse, r.mpd_guarded, alpha.get(r.fold), "OK"))
        except Exception as why:  # noqa: BLE001 - whatever ends one model, the others go on
            if len(asked) == 1:
                found.append((*asked, name, None, None, None, None, f"FAILED: {type(why).__name__}"))
            else:
                for year in asked:
                    add(name, score, (year,))

    def regression(asked: tuple[int, ...]) -> tuple[DataFrame, dict[int, float]]:
        scaled = stage(splits.scale_folds(splits.year_folds(rows, asked), ENHANCED_FEATURES).select("fold", "is_test", "y", *ENHANCED_FEATURES))
        fits = glm.fit_nb_groups(scaled.where("NOT is_test"), ENHANCED_FEATURES, "fold", grid=grid)
        return glm.predict_groups(scaled.where("is_test"), "fold", ENHANCED_FEATURES, fits), {i: f.alpha for i, f in fits.items()}

    def process(asked: tuple[int, ...]) -> tuple[DataFrame, dict[int, float]]:
        times = stage(etas.fold_times(binned, asked))
        test = splits.year_folds(rows, asked).where("is_test").select("fold", "cell_id", "week", "y")
        pred = etas.forecast(test, times, stage(etas.fit_cells(times)), days)
        return test.join(pred, ["fold", "cell_id", "week"]).withColumn("mu", F.col("lambda_pred")), {}

    if whole:
        add("NB_Enhanced", regression, whole)
        if binned is not None:
            add("ETAS", process, whole)
    jobs = [("Hybrid_NB", "nb", ENHANCED_FEATURES, 42), ("Neural_Poisson", "poisson", ENHANCED_FEATURES, 42)]
    nets = mlp.train_and_score(splits.year_folds(rows, years), jobs, how)
    nets = stage(nets.select(F.substring_index("job", ":", -1).cast("int").alias("year"), F.substring_index("job", ":", 1).alias("model"), "y", "mu", "alpha", "error"))
    fine = nets.where("error IS NULL")
    scored = metrics.basic_metrics(fine, "year", "model").join(fine.groupBy("year", "model").agg(F.avg("alpha").alias("alpha_hat")), ["year", "model"])
    net_rows = scored.select(
        "year", "model", "mae", "rmse", F.col("mpd_guarded").alias("mean_poisson_deviance"), F.when(F.col("model") == "Hybrid_NB", F.col("alpha_hat")).alias("alpha_hat"), F.lit("OK").alias("status")
    )
    nulls = [F.lit(None).cast("double").alias(c) for c in ("mae", "rmse", "mean_poisson_deviance", "alpha_hat")]
    bad = nets.where("error IS NOT NULL").select("year", "model", *nulls, F.concat(F.lit("FAILED: "), "error").alias("status"))
    return spark.createDataFrame(found, FOLD_SCORES).unionByName(net_rows).unionByName(bad)


def average_improvement(rows: DataFrame, base: str, other: str) -> DataFrame:
    """One row: percent by which `other`'s mean deviance lies below `base`'s."""
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("mean_poisson_deviance")))
    return rows.agg((F.lit(100.0) * (mean(base) - mean(other)) / mean(base)).alias("improvement_pct"))


def improvements(rows: DataFrame, base: str = "NB_Enhanced") -> DataFrame:
    """(model, mean_deviance, improvement_pct) of walk_forward(): every model's mean
    over the years that it has, and the percent by which it lies below the base's;
    null where the base has none or isn't above 0."""
    means = rows.groupBy("model").agg(F.avg("mean_poisson_deviance").alias("mean_deviance"))
    b = means.where(F.col("model") == base).select(F.col("mean_deviance").alias("_base"))
    gain = F.when(F.col("_base") > 0, F.lit(100.0) * (F.col("_base") - F.col("mean_deviance")) / F.col("_base"))
    return means.join(F.broadcast(b), how="left").select("model", "mean_deviance", gain.alias("improvement_pct"))
