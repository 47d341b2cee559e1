"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of all words; a target stops at
`max_epochs` times its source's size, and the excess goes to the others by
weight until none is above.  With the sources sorted by cap / weight the capped
ones are a prefix, so the water level follows from running sums.

A source then takes whole repetitions of all its documents, and once more the
documents at the front of a seeded order until the rest of the target is
reached to within half a document.  The order is by the hash of id and seed; it
is cut into 4,096 slices by the hash's first digits, slices get running sums
per source, and only inside a slice are documents ordered.  So a source with a
third of all rows is dealt over as many tasks as any.

DataFrame functions only.  A null or empty text has size 0 and is taken for 0
words; null is a source of its own, last in order; sources of size 0 have
target 0; rows that repeat an id are documents of their own; an empty table
gives an empty one, and further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.llm.shared import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights by the sources' code point order, null last: one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    return sources.withColumn("weight", weight.cast("double"))


def water_filling(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add `target` to (source, source_size, weight): one row per source."""
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_words") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    water = F.max(F.when(~F.col("capped"), F.struct((-F.col("cap_before")).alias("k"), F.col("level").alias("level")))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * water["level"])
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def mix(sized: DataFrame, weights: DataFrame | None = None, *, max_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for rows (doc_id, source, size).

    weights: (source, weight), all positive; by default 1, 2, 3 in turn.
    """
    rows = materialise(
        sized.select(
            "doc_id",
            "source",
            "size",
            F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit(""))).alias("sk"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
        ),
        "sized",
    ).withColumn("slice", F.substring("h", 1, 3))
    slices = rows.groupBy("sk", "slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source"))
    totals = slices.groupBy("sk").agg(F.sum("slice_size").alias("source_size"), F.first("source").alias("source"))
    if weights is None:
        totals = cyclic_weights(totals)
    else:
        given = weights.select(F.col("source").alias("source_w"), F.col("weight").cast("double").alias("weight"))
        totals = totals.join(given, F.col("source").eqNullSafe(F.col("source_w"))).drop("source_w")
    targets = water_filling(totals, max_epochs)
    key = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit("")))
    running = Window.partitionBy("sk").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        slices.drop("source")
        .withColumn("slices_before", F.coalesce(F.sum("slice_size").over(running), F.lit(0)))
        .join(targets.select(key.alias("sk"), "source_size", "target"), "sk")
        .drop("slice_size")
    )
    inside = Window.partitionBy("sk", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    before = F.col("slices_before") + F.col("inside_before")
    taken = F.col("size") * (F.col("whole") + F.when(2 * before + F.col("size") <= 2 * rest, 1).otherwise(0))
    return (
        rows.withColumn("inside_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(placed, ["sk", "slice"])
        .withColumn("whole", whole)
        .select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.cast("long").alias("taken"), "source")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).drop("source")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('0:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, (ARRAY[1.0, 2.0, 3.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    3.0::DOUBLE * source_size AS cap
  FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM weighted
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, level * weight >= cap AS capped FROM levels
), targets AS (
  SELECT source, source_size,
    CASE WHEN capped THEN cap ELSE weight * arg_min(level, place) FILTER (NOT capped) OVER () END AS target
  FROM marked
), ordered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    coalesce(floor(t.target / nullif(t.source_size, 0)::DOUBLE), 0)::BIGINT AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""
