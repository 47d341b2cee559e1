"""Exact percentiles of many groups at once, without a group's values in one buffer.

Values become counts of distinct values first, so copies of one value cost one
row.  Where no group has more than IN_BUFFER distinct values, those counts are
the buffer of `percentile`.  Otherwise every wanted rank has a range that holds it:
a pass counts the values of each range in BINS bins, the bin with the rank is the
next range, narrowed to the least and greatest value in it, and the rank is found
where these are equal.  As least and greatest never share a bin, each pass gets on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.grid import finite
from tesseral.sources.staging import stage

IN_BUFFER = 10_000
BINS = 512
#: Ranges beyond this number meet the counts in a join that isn't broadcast.
BROADCAST_ROWS = 100_000


def _bin() -> Column:
    """The bin of v in [lo, hi], never falling with v: by sign while the range has
    values of both or zero, by logarithm over magnitudes, else by equal widths.
    So some ten passes do for any doubles."""
    size = lambda c: F.log(F.abs(c))
    by_size = (size("v") - size("lo")) / (size("hi") - size("lo"))
    far = F.abs(F.log(F.abs("hi")) - F.log(F.abs("lo"))) > 1
    # The span is finite: both ends are within a factor e of each other.
    by_width = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    place = F.least(F.floor(F.when(far, by_size).otherwise(by_width) * BINS), F.lit(BINS - 1).cast("long"))
    return F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), (F.signum("v") + 1).cast("long")).otherwise(place)


def _narrow(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, rank, lo) with the value of each rank as lo."""
    while True:
        ranks = stage(ranks)
        unfinished = ranks.where("lo < hi")
        left = unfinished.count()
        if not left:
            return ranks
        ranges = unfinished.select("g", "lo", "hi").distinct()
        held = counts.join(F.broadcast(ranges) if left <= BROADCAST_ROWS else ranges, "g").where("v BETWEEN lo AND hi")
        bins = held.groupBy("g", "lo", "hi", _bin().alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        upward = Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("n").over(upward))
        before = F.col("below") + F.col("upto") - F.col("n")
        found = unfinished.join(bins, ["g", "lo", "hi"]).where((before <= F.col("rank")) & (F.col("rank") < before + F.col("n")))
        ranks = ranks.where("lo = hi").unionByName(found.select("g", "rank", F.col("least").alias("lo"), F.col("greatest").alias("hi"), before.alias("below")))


def percentiles(rows: DataFrame, keys: list[str], column: str, shares: list[float], in_buffer: int = IN_BUFFER) -> DataFrame:
    """(*keys, q): the percentiles of a numeric column at the shares (0 to 1), linear
    between neighbours, as an array in the shares' order.

    Nulls, NaN and infinities are left out; a group without any other value has a
    null q.  A null key is a group of its own.  Without keys there is one row,
    also for an empty table.
    """
    value = F.col(column).cast("double")
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    counts = stage(rows.select(group.alias("g"), F.when(finite(value), value).alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")))
    by = ["g"] if keys else []
    named = [F.col(f"g.`{k}`").alias(k) for k in keys]
    most = counts.groupBy(*by).agg(F.count("v").alias("n")).agg(F.max("n")).head()[0]
    if (most or 0) <= in_buffer:
        return counts.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, shares)), F.col("n")).alias("q")).select(*named, "q")
    valued = counts.where("v IS NOT NULL")
    groups = valued.groupBy("g").agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = [F.lit(float(p)) * (F.col("total") - 1) for p in shares]
    wanted = F.array_distinct(F.array(*(f(p).cast("long") for p in places for f in (F.floor, F.ceil))))
    start = groups.select("g", F.explode(wanted).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    # At most two values a share and group.
    known = _narrow(valued, start).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at"))
    at = lambda k: F.try_element_at("at", k.cast("long"))
    between = lambda p: F.when(F.floor(p) == F.ceil(p), at(F.floor(p))).otherwise(
        (F.ceil(p) - p) * at(F.floor(p)) + (p - F.floor(p)) * at(F.ceil(p))
    )
    found = groups.join(known, "g").select("g", F.array(*map(between, places)).alias("q"))
    return counts.select("g").distinct().join(found, "g", "left").select(*named, "q")
