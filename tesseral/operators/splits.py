"""Chronological splits, folds, encodings and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.config import TRAIN_SHARE


def week_cutoff(panel: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """One row: the first test week of a split by distinct weeks, and their number."""
    weeks = F.sort_array(F.collect_set("week"))
    return panel.agg(weeks.alias("w")).select(
        F.get("w", F.floor(F.size("w") * F.lit(share)).cast("int")).alias("cutoff"), F.size("w").alias("n_weeks")
    )


def calendar_cutoff(binned: DataFrame, unit: str, warm_up: int, share: float = TRAIN_SHARE) -> DataFrame:
    """week_cutoff() of the dense panel of binned events, from their first and
    last bucket alone: the panel has every bucket between but the warm-up."""
    span = binned.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    weeks = F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {unit}"))
    n = F.greatest(F.size("w") - warm_up, F.lit(0))
    return span.select(weeks.alias("w")).select(F.get("w", F.lit(warm_up) + F.floor(n * F.lit(share)).cast("int")).alias("cutoff"), n.alias("n_weeks"))


def split_by_week(panel: DataFrame, share: float = TRAIN_SHARE, cutoff: DataFrame | None = None) -> DataFrame:
    """Add is_test: the week is at or after the cutoff, the panel's own unless one is given."""
    at = (week_cutoff(panel, share) if cutoff is None else cutoff).select("cutoff")
    return panel.crossJoin(F.broadcast(at)).withColumn("is_test", F.col("week") >= F.col("cutoff")).drop("cutoff")


def tail_by_row(panel: DataFrame, share: float, order: str = "chronological") -> DataFrame:
    """Add in_tail: among the last `share` of rows by (week, cell), or, with
    order='cell_major', by (cell, week).

    Ranks come from counts per week (or cell), so no single task sorts all rows.
    """
    keys = ("week", "cell_id") if order == "chronological" else ("cell_id", "week")
    sums = panel.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy(keys[0]).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(keys[0]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = sums.select(keys[0], F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"), F.sum("k").over(total).alias("total"))
    inside = Window.partitionBy(keys[0]).orderBy(keys[1])
    ranked = panel.withColumn("r", F.row_number().over(inside)).join(placed, keys[0])
    return ranked.withColumn("in_tail", F.col("before") + F.col("r") > F.col("total") - F.floor(F.col("total") * F.lit(share))).drop("r", "before", "total")


def year_folds(panel: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Expanding folds: every row once for each test year that it trains or tests."""
    fold = F.explode(F.array(*map(F.lit, years))).alias("fold")
    rows = panel.select("*", fold).where(F.year("week") <= F.col("fold"))
    return rows.withColumn("is_test", F.year("week") == F.col("fold"))


def encode_cells(train: DataFrame, other: DataFrame, order: str = "sorted") -> DataFrame:
    """other with cell_idx: the place of its cell among train's, the number of
    those for a cell that train lacks.  order: 'sorted', or 'first_seen' by week
    and cell."""
    if order == "sorted":
        keyed = train.select("cell_id").distinct().withColumn("k", F.col("cell_id"))
    else:
        keyed = train.groupBy("cell_id").agg(F.min(F.struct("week", "cell_id")).alias("k"))
    codes = keyed.select("cell_id", (F.dense_rank().over(Window.orderBy("k")) - 1).cast("long").alias("code"))
    unknown = codes.agg(F.count(F.lit(1)).alias("n_codes"))
    return other.join(codes, "cell_id", "left").crossJoin(F.broadcast(unknown)).withColumn("cell_idx", F.coalesce("code", "n_codes")).drop("code", "n_codes")


def fit_scaler(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(feature, mean, scale): population standard deviation, 1 where it is 0."""
    stats = rows.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("sd")) for c in columns)))
    out = stats.select(parts.alias("x")).select("x.*")
    return out.select("feature", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)).alias("scale"))


def scale(rows: DataFrame, columns: tuple[str, ...], scaler: DataFrame) -> DataFrame:
    """The columns standardised by a fitted scaler, whose rows fit one per feature."""
    fitted = {r.feature: (r.mean, r.scale) for r in scaler.collect()}
    return rows.withColumns({c: (F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1]) for c in columns})


def scale_folds(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """year_folds() with the columns standardised on each fold's train rows, as
    scale() by fit_scaler() of that fold alone."""
    train = rows.where("NOT is_test").groupBy("fold")
    stats = train.agg(*(x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    unit = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / unit(c) for c in columns}
    return rows.join(F.broadcast(stats), "fold").withColumns(scaled).drop(*(f"_{x}_{c}" for x in "ms" for c in columns))
