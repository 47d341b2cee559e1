"""Error metrics by stratum, calibration, and residuals of predictions.

Predictions are long tables (model, family, alpha, cell_id, week, y, mu);
family is 'nb' or 'poisson'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.config import FLOOR, PIT_FLOOR
from tesseral.functions import dist
from tesseral.operators.quantiles import percentiles
from tesseral.sources.staging import stage

PREDICTION = ("model", "family", "alpha", "cell_id", "week", "y", "mu")
STRATA = ("Q1 (low)", "Q2", "Q3", "Q4 (high)", "Y>=5", "All")


def predictions_long(wide: DataFrame, models: dict[str, tuple[str, str, float | None]]) -> DataFrame:
    """Rows per model from one column per model; models: name -> (column, family, alpha)."""
    parts = F.array(
        *(
            F.struct(F.lit(m).alias("model"), F.lit(f).alias("family"), F.lit(a).cast("double").alias("alpha"), F.col(c).cast("double").alias("mu"))
            for m, (c, f, a) in models.items()
        )
    )
    rows = wide.select("cell_id", "week", "y", F.explode(parts).alias("p"))
    return rows.select("p.model", "p.family", "p.alpha", "cell_id", "week", "y", F.greatest("p.mu", F.lit(FLOOR)).alias("mu"))


def basic_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    y, mu = F.col("y"), F.col("mu")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - mu)).alias("mae"),
        F.sqrt(F.avg(F.pow(y - mu, 2))).alias("rmse"),
        F.avg(dist.poisson_deviance(y, mu)).alias("mpd"),
        F.avg(dist.poisson_deviance_guarded(y, mu)).alias("mpd_guarded"),
    )


def with_strata(rows: DataFrame) -> DataFrame:
    """One row per stratum that holds the prediction: quartiles of its model's y, y >= 5, all."""
    q = percentiles(rows, ["model"], "y", [0.25, 0.5, 0.75])
    y, q25, q50, q75 = F.col("y"), F.get("q", F.lit(0)), F.get("q", F.lit(1)), F.get("q", F.lit(2))
    inside = (y <= q25, (y > q25) & (y <= q50), (y > q50) & (y <= q75), y > q75, y >= 5, F.lit(True))
    labels = F.array_compact(F.array(*(F.when(c, F.lit(s)) for c, s in zip(inside, STRATA, strict=True))))
    return rows.join(F.broadcast(q), "model").withColumn("stratum", F.explode(labels)).drop("q")


def tail_evaluation(rows: DataFrame) -> DataFrame:
    """n, MAE, RMSE, deviance, negative log-likelihood (as is, and complete for
    both families) and CRPS by model and stratum; empty strata are absent."""
    y, mu, alpha, family = F.col("y"), F.col("mu"), F.coalesce("alpha", F.lit(1.0)), F.col("family")
    labelled = with_strata(stage(rows))
    k_max = percentiles(labelled, ["model", "stratum"], "y", [0.99]).select("model", "stratum", (F.floor(F.get("q", F.lit(0))) + 20).alias("k_max"))
    nll = F.when(family == "nb", dist.nb_nll(y, mu, alpha)).otherwise(dist.poisson_nll(y, mu))
    full = F.when(family == "nb", dist.nb_nll(y, mu, alpha)).otherwise(dist.poisson_nll_full(y, mu))
    score = dist.crps(family, y, mu, alpha, F.col("k_max"))
    # Equal (y, mu) of a stratum have equal scores: the folds run once for each.
    distinct = labelled.groupBy("model", "stratum", "family", "alpha", "y", "mu").agg(F.count(F.lit(1)).alias("k"))
    scored = distinct.join(F.broadcast(k_max), ["model", "stratum"]).select("*", nll.alias("nll"), full.alias("nll_full"), score.alias("crps"))
    mean = lambda c: F.sum(F.col("k") * c) / F.sum("k")
    return scored.groupBy("model", "stratum").agg(
        F.sum("k").alias("n"),
        mean(F.abs(y - mu)).alias("mae"),
        F.sqrt(mean(F.pow(y - mu, 2))).alias("rmse"),
        mean(dist.poisson_deviance(y, mu)).alias("mpd"),
        mean(F.col("nll")).alias("nll"),
        mean(F.col("nll_full")).alias("nll_full"),
        mean(F.col("crps")).alias("crps"),
    )


def deviance_by_stratum(tail: DataFrame) -> DataFrame:
    """One row per model of a tail_evaluation() table, its deviance by stratum; null where that is empty."""
    return tail.groupBy("model").pivot("stratum", list(STRATA[:-1])).agg(F.first("mpd"))


def pit_values(rows: DataFrame, u: str) -> DataFrame:
    """Add the randomised probability integral transform from a column of uniforms."""
    alpha = F.coalesce("alpha", F.lit(1.0))
    return rows.withColumn("pit", dist.randomised_pit(F.col("family"), F.col("y"), F.col("mu"), alpha, F.col(u), PIT_FLOOR))


def pit_histogram(pits: DataFrame, bins: int = 10) -> DataFrame:
    """(model, bin, n, freq) with all bins."""
    counts = pits.groupBy("model", F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1).cast("long")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = pits.groupBy("model").agg(F.count("pit").alias("total")).select("model", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["model", "bin"], "left").na.fill({"n": 0}).select("model", "bin", "n", (F.col("n") / F.col("total")).alias("freq"))


def calibration_summary(pits: DataFrame, bins: int = 10) -> DataFrame:
    """n, mean and sample variance of the PIT, and its histogram's mean distance from uniform."""
    spread = pits.groupBy("model").agg(F.count("pit").alias("n"), F.avg("pit").alias("pit_mean"), F.var_samp("pit").alias("pit_var"))
    off = pit_histogram(pits, bins).groupBy("model").agg(F.avg(F.abs(F.col("freq") - 1.0 / bins)).alias("pit_l1_uniform"))
    return spread.join(off, "model").orderBy("model")


def pearson_residuals(rows: DataFrame) -> DataFrame:
    """Add (y - mu) / sd with the family's variance."""
    var = F.col("mu") + F.when(F.col("family") == "nb", F.coalesce("alpha", F.lit(0.0)) * F.pow("mu", F.lit(2))).otherwise(F.lit(0.0))
    return rows.withColumn("residual", (F.col("y") - F.col("mu")) / F.sqrt(F.greatest(var, F.lit(FLOOR))))


def prediction_band(rows: DataFrame, z: float = 1.96) -> DataFrame:
    """Add low and high: mu -+ z standard deviations, not below 0."""
    sd = F.sqrt(F.col("mu") + F.coalesce("alpha", F.lit(0.0)) * F.pow("mu", F.lit(2)))
    return rows.withColumn("low", F.greatest(F.col("mu") - z * sd, F.lit(0.0))).withColumn("high", F.col("mu") + z * sd)
