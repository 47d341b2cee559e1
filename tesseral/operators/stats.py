"""Dispersion, histograms, magnitude of completeness and b-value, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.config import BIN_WIDTH, LN10, MC_CORRECTION, MIN_EVENTS_B
from tesseral.functions.grid import edges, finite
from tesseral.operators.quantiles import percentiles
from tesseral.sources.staging import stage


def cell_dispersion(panel: DataFrame) -> DataFrame:
    """Mean, sample variance and their ratio by cell; no ratio where the mean is 0."""
    out = panel.groupBy("cell_id").agg(F.avg("y").alias("mean_y"), F.var_samp("y").alias("var_y"))
    return out.withColumn("d_cell", F.when(F.col("mean_y") > 0, F.col("var_y") / F.col("mean_y")))


def mean_variance(panel: DataFrame) -> DataFrame:
    """(cell_id, mean_y, var_y, ratio) of the cells with positive mean and
    variance, ratio being the mean of their variances over that of their means."""
    cells = cell_dispersion(panel).where("mean_y > 0 AND var_y > 0")
    ratio = cells.agg((F.avg("var_y") / F.avg("mean_y")).alias("ratio"))
    return cells.select("cell_id", "mean_y", "var_y").crossJoin(F.broadcast(ratio))


def global_dispersion(panel: DataFrame) -> DataFrame:
    out = panel.agg(F.avg("y").alias("mean_y"), F.var_samp("y").alias("var_y"))
    return out.withColumn("d", F.when(F.col("mean_y") > 0, F.col("var_y") / F.col("mean_y")))


def dispersion_verdict(d: Column) -> Column:
    return F.when(d <= 1.2, "poisson plausible").when(d <= 2.0, "moderate overdispersion").when(d.isNotNull(), "strong overdispersion")


def dispersion_summary(panel: DataFrame) -> DataFrame:
    """One row: global figures, mean and median of the cells' ratios, shares above 1 and 1.5."""
    ratios = stage(cell_dispersion(panel))
    middle = percentiles(ratios, [], "d_cell", [0.5]).select(F.get("q", F.lit(0)).alias("median_d_cell"))
    cells = ratios.agg(
        F.avg("d_cell").alias("mean_d_cell"),
        F.avg(F.when(F.col("d_cell") > 1.0, 100.0).when(F.col("d_cell").isNotNull(), 0.0)).alias("pct_above_1"),
        F.avg(F.when(F.col("d_cell") > 1.5, 100.0).when(F.col("d_cell").isNotNull(), 0.0)).alias("pct_above_1_5"),
    )
    return global_dispersion(panel).crossJoin(cells).crossJoin(middle).withColumn("verdict", dispersion_verdict(F.col("d")))


def reconciliation(binned: DataFrame, sparse: DataFrame, base: DataFrame) -> DataFrame:
    """One row: events before and after aggregation and densification, and whether all agree."""
    n = binned.agg(F.count("mag").alias("n_events"))
    s, d = sparse.agg(F.sum("y").alias("n_sparse")), base.agg(F.sum("y").alias("n_dense"))
    out = n.crossJoin(s).crossJoin(d)
    return out.withColumn("ok", (F.col("n_events") > 0) & (F.col("n_events") == F.col("n_sparse")) & (F.col("n_sparse") == F.col("n_dense")))


def magnitude_histogram(events: DataFrame, width: float = BIN_WIDTH) -> DataFrame:
    """(bin, low, center, n, n_at_least) over all bins of the magnitudes' range.

    Edges are sums low + k * width as doubles, compared as such; the last bin is
    closed.  n_at_least counts magnitudes from half a bin below the center on.
    """
    mags = events.where("mag IS NOT NULL").select("mag")
    span = mags.agg(F.min("mag").alias("a"), F.max("mag").alias("b")).select(
        (F.floor(F.col("a") / width) * F.lit(width)).alias("lo"), (F.ceil(F.col("b") / width) * F.lit(width)).alias("hi")
    )
    cut = span.where("lo IS NOT NULL").select(edges(F.col("lo"), F.col("hi"), width).alias("edges"))
    n_bins = F.size("edges") - 1
    place = F.least(F.size(F.filter("edges", lambda e: e <= F.col("mag"))), n_bins) - 1
    # A map-side combine by distinct magnitude keeps the edge search off the event rows.
    counts = mags.groupBy("mag").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(cut)).groupBy(place.alias("bin")).agg(F.sum("n").alias("n"))
    bins = cut.select(F.posexplode(F.slice("edges", 1, n_bins)).alias("bin", "low"), F.col("edges").alias("e"))
    bins = bins.select("bin", "low", (F.lit(0.5) * (F.col("low") + F.get("e", F.col("bin") + 1))).alias("center"))
    upward = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = bins.join(counts, "bin", "left").na.fill({"n": 0})
    return out.withColumn("n_at_least", F.sum("n").over(upward))


def completeness(events: DataFrame, width: float = BIN_WIDTH) -> DataFrame:
    """One row: magnitude of completeness by maximum curvature, and Aki's b-value.

    The fullest bin (the first of equals) gives its center + 0.2, rounded
    half-even to the bin width; b needs ten magnitudes at or above that.
    """
    top = magnitude_histogram(events, width).orderBy(F.col("n").desc(), "bin").limit(1)
    mc = top.select((F.bround((F.col("center") + MC_CORRECTION) / width, 0) * F.lit(width)).alias("m_c_estimate"))
    used = F.when(F.col("mag") >= F.col("m_c_estimate"), F.col("mag"))
    out = (
        events.where("mag IS NOT NULL")
        .crossJoin(F.broadcast(mc))
        .groupBy("m_c_estimate")
        .agg(F.count(used).alias("n_used"), F.avg(used).alias("mean_used"), F.count(F.lit(1)).alias("n_total"))
    )
    b = F.when(F.col("n_used") >= MIN_EVENTS_B, F.lit(1.0) / (F.lit(LN10) * (F.col("mean_used") - F.col("m_c_estimate") + width / 2)))
    return out.select("m_c_estimate", b.alias("b_value"), "n_used", "n_total", F.lit("maximum curvature").alias("method"))


def value_counts(panel: DataFrame, column: str = "y") -> DataFrame:
    return panel.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def zero_share(panel: DataFrame) -> DataFrame:
    return panel.agg((F.avg((F.col("y") == 0).cast("double")) * 100).alias("zero_pct"), F.count(F.lit(1)).alias("n"))


def busiest_cell(panel: DataFrame) -> DataFrame:
    """The cell with most events; of equals the least id."""
    return panel.groupBy("cell_id").agg(F.sum("y").alias("total")).orderBy(F.col("total").desc(), "cell_id").limit(1)


def last_buckets(panel: DataFrame, n: int = 52) -> DataFrame:
    """The last n buckets of the busiest cell."""
    one = panel.join(F.broadcast(busiest_cell(panel)), "cell_id")
    late = Window.partitionBy("cell_id").orderBy(F.col("week").desc())
    return one.withColumn("rank", F.row_number().over(late)).where(F.col("rank") <= n).select("cell_id", "week", "y", "rank")


def forecast_series(test: DataFrame, *predictions: str) -> DataFrame:
    """The busiest cell's test rows by week: its counts beside those of the
    prediction columns that the table has."""
    there = [c for c in predictions if c in test.columns]
    return test.join(F.broadcast(busiest_cell(test).select("cell_id")), "cell_id").select("cell_id", "week", "y", *there).orderBy("week")


def equal_width_histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) over the column's range, the last bin closed."""
    span = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo IS NOT NULL")
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)) / bins
    place = F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1).cast("long"))
    counts = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("width"))
    out = grid.join(counts, "bin", "left").na.fill({"n": 0})
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n")


def alpha_histogram(rows: DataFrame, bins: int = 40) -> DataFrame:
    """(bin, low, high, n) of the finite predicted alphas."""
    return equal_width_histogram(rows.where(finite(F.col("alpha_pred"))), "alpha_pred", bins)


def alpha_audit(rows: DataFrame, *keys: str) -> DataFrame:
    """n, mean, median, 10 % and 90 % quantiles and the share below 0.01 of finite alphas."""
    a = F.col("alpha_pred")
    rows = rows.where(finite(a))
    shares = {"median_alpha": 0.5, "q10_alpha": 0.1, "q90_alpha": 0.9}
    q = percentiles(rows, list(keys), "alpha_pred", list(shares.values()))
    q = q.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.get("q", F.lit(i)).alias(c) for i, c in enumerate(shares)))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_alpha"), F.avg((a < 1e-2).cast("double")).alias("share_alpha_below_1e_2"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return out.join(q, same or F.lit(True), "left").select(*keys, "n", "mean_alpha", *shares, "share_alpha_below_1e_2")
