"""The whole study over one catalogue: from events and panel to the twelve result tables.

Every diagnostic is of the fitted models' own test predictions, which are stored
once and read by all.  A step that fails leaves its table out, with the reason
in the report, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.config import ALPHA_GRID, IDENTIFIABILITY_SEEDS
from tesseral.functions.grid import portable_uniform
from tesseral.operators import evaluation as V, metrics, mlp, stats
from tesseral.sources import catalogue, keyed
from tesseral.sources.staging import stage


def static_models(panel: DataFrame, binned: DataFrame, folder: str, days: float, grid: tuple[float, ...], how: mlp.Training, m_c: float) -> tuple[dict, DataFrame, DataFrame]:
    """Fit the regressions, the networks and the point process on the split by
    week.  Upserts each one's rows into folder/comparison by model; returns the
    regressions' fits, and the predictions of the regressions and of the networks."""
    at = f"{folder}/comparison"
    rows, fits = V.classical_models(panel, grid)
    keyed.upsert(rows, at, ["model"])
    classical = stage(V.classical_predictions(panel, fits))
    nets = stage(V.network_predictions(panel, how=how))
    keyed.upsert(V.network_comparison(nets), at, ["model"])
    try:
        process = V.comparison_row("ETAS_Per_Cell", "ETAS", V.etas_static(binned, panel, days, m_c), None)
        keyed.upsert(process, at, ["model"])
    except Exception as why:  # noqa: BLE001 - the point process is one model of several
        keyed.upsert(V.failed(panel.sparkSession, "ETAS_Per_Cell", "ETAS", why), at, ["model"])
    return fits, classical, nets.where("error IS NULL").drop("error")


def run(
    events: DataFrame, binned: DataFrame, panel: DataFrame, folder: str, years: tuple[int, ...], days: float = 7.0, grid: tuple[float, ...] = ALPHA_GRID,
    how: mlp.Training = mlp.Training(), folds: mlp.Training = mlp.WALK_FORWARD, seeds: tuple[int, ...] = IDENTIFIABILITY_SEEDS, m_c: float = 3.0,
) -> DataFrame:
    """Write the RESULTS of the catalogue to the folder; a row for each: (result, n_rows, status)."""
    spark, folder, report = panel.sparkSession, folder.rstrip("/"), {}
    panel = stage(panel)
    cells = panel.select("cell_id", "lat_grid", "lon_grid").distinct()

    def step(name: str, table: Callable[[], DataFrame]) -> None:
        try:
            if name != "comparison":
                catalogue.write_results({name: table()}, folder)
            report[name] = table().count() if name == "comparison" else spark.read.parquet(f"{folder}/{name}").count(), "OK"
        except Exception as why:  # noqa: BLE001 - whatever ends a step, the others go on
            report[name] = None, f"FAILED: {type(why).__name__}"

    step("completeness", lambda: stats.completeness(events))
    step("cell_dispersion", lambda: stats.cell_dispersion(panel))
    fits, classical, nets = static_models(panel, binned, folder, days, grid, how, m_c)
    comparison = keyed.read(spark, f"{folder}/comparison")
    step("comparison", lambda: comparison)
    step("overdispersion_test", lambda: V.overdispersion_row(spark, fits["Poisson_Enhanced"], fits["NB_Enhanced"]))
    step("test_predictions", lambda: classical)
    step("calibration_predictions", lambda: classical.where("model = 'NB_Enhanced'").unionByName(nets))
    both = stage(classical.unionByName(nets))
    place = F.pmod(F.xxhash64("cell_id", "week"), F.lit(1 << 31))
    step("calibration", lambda: metrics.calibration_summary(stage(metrics.pit_values(both.withColumn("u", portable_uniform(place)), "u"))))
    step("tail_evaluation", lambda: metrics.tail_evaluation(both))
    step("spatial_diagnostics", lambda: V.spatial_diagnostics(both, comparison, cells))
    step("alpha_audit", lambda: stats.alpha_audit(nets.where("family = 'nb'").withColumn("alpha_pred", F.col("alpha")), "model"))
    step("identifiability", lambda: stats.alpha_audit(V.identifiability(panel, seeds, how), "seed"))
    step("walk_forward", lambda: V.walk_forward(panel, binned, years, days, grid, folds))
    return spark.createDataFrame([(k, *v) for k, v in report.items()], "result string, n_rows long, status string")
