"""Spatial autocorrelation of residuals on the lattice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.counter import places
from tesseral.sources.staging import stage

#: Runs that an edge meets in one row; values (cells by models) that all tasks may hold: 32 MB.
RUNS, MAX_VALUES = 50, 4_000_000


def queen_weights(cells: DataFrame, size: float = 3.0) -> DataFrame:
    """(cell_i, cell_j, w): the up to eight neighbours of each cell, weights of a
    row summing to 1.  Neighbours meet by an equi-join on lattice places and
    their eight offsets; isolated cells have no row."""
    cells = cells.select("cell_id", "lat_grid", "lon_grid").dropDuplicates(["cell_id"])
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)))
    base = cells.agg(F.min("lat_grid").alias("lat0"), F.min("lon_grid").alias("lon0"))
    placed = cells.crossJoin(F.broadcast(base)).select(
        "cell_id",
        F.round((F.col("lat_grid") - F.col("lat0")) / size).cast("long").alias("r"),
        F.round((F.col("lon_grid") - F.col("lon0")) / size).cast("long").alias("c"),
    )
    from_i = placed.select(F.col("cell_id").alias("cell_i"), "r", "c", F.explode(offsets).alias("o")).select(
        "cell_i", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c")
    )
    pairs = from_i.join(placed.withColumnRenamed("cell_id", "cell_j"), ["r", "c"]).select("cell_i", "cell_j")
    degree = pairs.groupBy("cell_i").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    return pairs.join(degree, "cell_i").select("cell_i", "cell_j", "w")


def cell_means(rows: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """(model, cell_id, x): means by cell, 0 for cells without rows."""
    models = rows.select("model").distinct()
    means = rows.groupBy("model", "cell_id").agg(F.avg(value).alias("x"))
    grid = cells.select("cell_id").distinct().crossJoin(F.broadcast(models))
    return grid.join(means, ["model", "cell_id"], "left").na.fill({"x": 0.0})


def morans_i(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(model, moran_i): null where all values are equal or no cell has a neighbour."""
    x, spread = F.col("x"), values.groupBy("model").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n"))
    i, j = values.select("model", F.col("cell_id").alias("cell_i"), x.alias("xi")), values.select("model", F.col("cell_id").alias("cell_j"), x.alias("xj"))
    pairs = weights.join(i, "cell_i").join(j, ["model", "cell_j"]).join(F.broadcast(spread), "model")
    cross = pairs.groupBy("model").agg(
        F.sum(F.col("w") * (F.col("xi") - F.col("mean")) * (F.col("xj") - F.col("mean"))).alias("num"), F.sum("w").alias("sw")
    )
    base = F.col("sw") * F.col("n") * F.col("var")
    return spread.join(cross, "model", "left").select("model", F.when(F.abs(base) >= 1e-12, F.col("n") * F.col("num") / base).alias("moran_i"))


def numbered(cells: DataFrame, slices: int = 1_024) -> DataFrame:
    """(cell_id, k): the cells' numbers from 0, in an order that depends on nothing
    but the cells; counts by slice make them, so no task sorts all cells."""
    sliced = cells.select("cell_id").distinct().withColumn("s", F.pmod(F.xxhash64("cell_id"), F.lit(slices)))
    counts = sliced.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("s", F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("s").orderBy("cell_id")) - 1
    return sliced.withColumn("i", inside).join(before, "s").select("cell_id", (F.col("before") + F.col("i")).alias("k"))


def _drawn_sums(edges: DataFrame, values: DataFrame, n: int, runs: int, seed: int) -> DataFrame:
    """(model, run, num): sums of w * x * x over the edges (i, j, w), each cell with
    the value of the cell that the run's permutation puts there.

    edges come with blocks of runs, `first` to `last`.  Up to MAX_VALUES values go
    to all tasks; beyond, the permuted ends meet their values in joins."""
    models = sorted(r.model for r in values.select("model").distinct().collect())

    def ends(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        first, last, i, j, w = (batch.column(k).to_numpy() for k in range(5))
        for block in np.unique(first):
            own = first == block
            for run in range(int(block), int(last[own][0])):
                yield run, places(i[own], n, seed, run), places(j[own], n, seed, run), w[own]

    if n * len(models) <= MAX_VALUES:
        table = np.zeros((len(models), n))
        rows = values.select("model", "k", "x").toArrow()
        table[np.searchsorted(models, rows["model"].to_pylist()), rows["k"].to_numpy()] = rows["x"].to_numpy()
        sent = edges.sparkSession.sparkContext.broadcast(table)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(models), runs))
            seen = np.zeros(runs, dtype=bool)
            for batch in batches:
                for run, i, j, w in ends(batch):
                    total[:, run] += (sent.value[:, i] * sent.value[:, j]) @ w
                    seen[run] = True
            at = np.flatnonzero(seen)
            for k, model in enumerate(models):
                yield pa.RecordBatch.from_pydict({"model": pa.array([model] * len(at), pa.string()), "run": pa.array(at), "num": pa.array(total[k, at])})

        sums = edges.mapInArrow(add, "model string, run long, num double")
    else:

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for run, i, j, w in ends(batch):
                    yield pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(i), run)), "i": pa.array(i), "j": pa.array(j), "w": pa.array(w)})

        pairs = edges.mapInArrow(spread, "run long, i long, j long, w double")
        at = lambda k: values.select("model", F.col("k").alias(k), F.col("x").alias(f"x{k}"))
        sums = pairs.join(at("i"), "i").join(at("j"), ["model", "j"]).select("model", "run", (F.col("w") * F.col("xi") * F.col("xj")).alias("num"))
    return sums.groupBy("model", "run").agg(F.sum("num").alias("num"))


def permutation_test(values: DataFrame, weights: DataFrame, runs: int = 999, seed: int = 42) -> DataFrame:
    """(model, moran_i, z_score, p_perm): the share of seeded permutations with an
    index at least as great (differences of 1e-12 are rounding, and count as equal).

    Edges meet blocks of runs, and these rows are dealt over tasks; a permutation
    is a function of the cell's number, so no task holds all cells in order or
    all edges, and the result doesn't depend on how the rows are dealt."""
    values, weights = stage(values), stage(weights)
    codes = stage(numbered(values))
    n = codes.count()
    spread = values.groupBy("model").agg(F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("squares"))
    centred = values.join(F.broadcast(spread.select("model", "mean")), "model").join(codes, "cell_id").select("model", "k", (F.col("x") - F.col("mean")).alias("x"))
    blocks = F.array(*(F.struct(F.lit(a).cast("long").alias("first"), F.lit(min(runs, a + RUNS)).cast("long").alias("last")) for a in range(0, runs, RUNS)))
    coded = weights.join(codes.toDF("cell_i", "i"), "cell_i").join(codes.toDF("cell_j", "j"), "cell_j")
    edges = coded.select(F.explode(blocks).alias("b"), "i", "j", "w").select("b.first", "b.last", "i", "j", "w")
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = _drawn_sums(edges.repartition(parts, "first", "i"), centred, n, runs, seed)
    total = weights.agg(F.sum("w").alias("sw"))
    indices = drawn.join(F.broadcast(spread), "model").crossJoin(F.broadcast(total)).select("model", F.try_divide(F.lit(n) * F.col("num"), F.col("sw") * F.col("squares")).alias("drawn"))
    seen = morans_i(values, weights)
    judged = indices.join(F.broadcast(seen), "model").groupBy("model").agg(
        F.avg("drawn").alias("mean"), F.stddev_samp("drawn").alias("sd"), F.avg((F.col("drawn") >= F.col("moran_i") - F.lit(1e-12)).cast("double")).alias("p_perm")
    )
    z = (F.col("moran_i") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(1e-12))
    fine = F.col("moran_i").isNotNull()
    return seen.join(judged, "model", "left").select("model", "moran_i", F.when(fine, z).alias("z_score"), F.when(fine, F.col("p_perm")).alias("p_perm"))
