"""Threshold-scaled fingerprints: of a text's five-word shingles every hash
below a fixed fraction of the hash range is kept, and no other.

Whether a shingle is kept depends on nothing but itself, so sketches of shingle
sets merge by union, and the share of a short text's hashes found in a long
one's estimates containment however unequal they are.  A text whose shingles
all miss the threshold has an empty fingerprint, as one without words has; of
texts with 16 shingles that is one in a hundred.  A fingerprint is the sorted
distinct first 16 hexadecimal digits of the kept shingles' MD5, joined without
separators; equal texts have equal ones.

DataFrame functions only.  Words are lower-cased runs as in the n-gram join;
with fewer than five the whole sequence is one shingle.  Null text counts as
empty, empty fingerprints are like nothing (0), not even each other, unless the
texts are equal (1).  Rows that repeat an id are in the order of their texts
and in one slice; null ids come first.  A table of one row has itself as the
next one, an empty table gives an empty one, and further columns are not looked
at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kept share of the hash range: a quarter, MD5s with a first hexadecimal digit below 4.
BELOW = "4"
DIGITS = 16
#: Quantiles of the id that cut the order into slices, slices by task, bytes of
#: text in a task (and once there are MANY_TASKS), and slices of which the first
#: ids are sent to all tasks at most.
QUANTILES, SLICES, TASK_BYTES, MANY_TASKS, MOST_BYTES, SENT_SLICES = 256, 8, 4 << 20, 20_000, 128 << 20, 100_000


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), SPACE), lambda w: w != "")


def sketch(text: Column, *, size: int = 5, below: str = BELOW) -> Column:
    """The kept hashes of a text as a sorted array of distinct strings.

    below: hashes that sort before this hexadecimal string are kept.
    """

    def of(ws: Column) -> Column:
        n = F.size(ws)
        last = F.greatest(n - size + 1, F.lit(1))
        parts = lambda i: F.substring(F.md5(F.array_join(F.slice(ws, i, size), " ")), 1, DIGITS)
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), last), parts))

    def keep(hashes: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < below)))

    # One-element transforms name a value, so that it is computed once.
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return once(words(text), lambda ws: once(of(ws), keep))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")), F.lit(0.0))


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of two shingle sets from their sketches."""
    return F.array_sort(F.array_union(a, b))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, own, next_text, next_own): every row's text and sketch and
    those of the next row by id, after the last the first.

    Each text's sketch is taken once, where the text has moved to, and passed on
    to the row before it.  The order is cut into slices by approximate quantiles
    of the id and evenly between two of them; each row moves once to its slice,
    a task gets SLICES of them in a row, and the number of tasks follows the
    bytes of all texts.  The last row of a slice takes the first text of the next occupied one.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    amount, low, high = ids.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.min("id"), F.max("id")).head()
    parts = max(min(amount // TASK_BYTES, MANY_TASKS), amount // MOST_BYTES) + 1
    marks = ids.where("id IS NOT NULL").approxQuantile("id", [k / QUANTILES for k in range(1, QUANTILES)], 0.1 / QUANTILES)
    bounds = sorted({int(x) for x in marks} | {x for x in (low, high) if x is not None})
    finer = SLICES * parts // QUANTILES + 1
    placed = ids.withColumn("slice", _slice_of(F.col("id"), bounds, finer))
    # The first row of each slice, found without moving texts, then only those texts.
    known = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"))
    firsts = placed.groupBy("slice").agg(F.min(known).alias("f"))
    ring = Window.orderBy("slice")
    last = F.max("slice").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ringed = firsts.select("f", F.coalesce(F.lag("slice").over(ring), last).alias("before"))
    if finer * (len(bounds) + 1) <= SENT_SLICES:
        ringed = F.broadcast(ringed)
    heads = ids.withColumn("f", known).join(ringed, "f").groupBy("before").agg(F.min("text").alias("text"))
    # They close the slice before as rows of their own, so that nothing moves but to its slice.
    ends = heads.select(F.lit(None).cast("long").alias("id"), "text", F.col("before").alias("slice"), F.lit(True).alias("end"))
    rows = placed.withColumn("end", F.lit(False)).unionByName(ends)
    order = Window.partitionBy("slice").orderBy("end", F.col("id").asc_nulls_first(), "text")
    moved = rows.repartitionByRange(parts, "slice").withColumn("own", sketch(F.col("text")))
    led = moved.select("*", F.lead("text").over(order).alias("next_text"), F.lead("own").over(order).alias("next_own"))
    return led.where("NOT end").select("id", "text", "own", "next_text", "next_own")


def _slice_of(value: Column, bounds: list[int], finer: int) -> Column:
    """The number of the value's slice: how many bounds are at or below it, by a
    tree of comparisons, and which of `finer` even parts up to the next bound."""

    def part(k: int) -> Column:
        if finer == 1 or not 0 < k < len(bounds):
            return F.lit(k * finer).cast("long")
        low, high = bounds[k - 1], bounds[k]
        return (F.lit(k * finer) + F.floor((value.cast("double") - float(low)) / float(high - low) * finer)).cast("long")

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return part(lo)
        mid = (lo + hi) // 2
        return F.when(value < bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(value.isNull(), F.lit(-1).cast("long")).otherwise(tree(0, len(bounds)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, sketch) of every row."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(id_col, text.alias("text"), sketch(text).alias("sketch"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    swap = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - swap)"), F.expr("substring(next_text, 1, swap)"))
    rows = (
        with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
        .withColumn("swap", swap)
        .select("id", "text", "own", "next_text", "next_own", edited.alias("edited"))
        .select(
            "id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            "own",
            sketch(F.col("edited")).alias("other"),
            F.col("next_own").alias("next"),
            (F.col("text") == F.col("edited")).alias("same"),
            (F.col("text") == F.col("next_text")).alias("same_next"),
        )
    )
    near = lambda of, other, same: F.round(F.when(F.col(same), 1.0).otherwise(of(F.col("own"), F.col(other))), 6)
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("other", "").alias("edited_fingerprint"),
        near(likeness, "other", "same").alias("near_edited"),
        near(likeness, "next", "same_next").alias("near_next"),
        near(containment, "other", "same").alias("held_by_edited"),
        near(containment, "next", "same_next").alias("held_by_next"),
    )


def _sql_hashes(column: str) -> str:
    """SQL of all shingle hashes; `column` holds a list of words."""
    w = f"regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
    return (
        f"list_transform([{w}], lambda w: CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 3, 2)::BIGINT), "
        "lambda i: substr(md5(array_to_string(w[i:i+4], ' ')), 1, 16)) END)[1]"
    )


def _sql_sketch(hashes: str) -> str:
    return f"list_sort(list_distinct(list_filter({hashes}, lambda h: h < '{BELOW}')))"


def _sql_near(same: str, other: str, whole: str) -> str:
    return f"round(CASE WHEN text = {same} THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(s1, {other}))::DOUBLE / nullif(len({whole}), 0), 0) END, 6)"


OP9_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), hashed AS MATERIALIZED (
  SELECT doc_id, text, {_sql_hashes("text")} AS h1 FROM texts
), owned AS MATERIALIZED (
  SELECT doc_id, text, {_sql_sketch("h1")} AS s1 FROM hashed
), nexts AS (
  SELECT doc_id, text, s1, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text,
    coalesce(lead(s1) OVER o, first_value(s1) OVER o) AS s3
  FROM owned WINDOW o AS (ORDER BY doc_id NULLS FIRST, text)
), edits AS (
  SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM nexts
), edited_hashes AS MATERIALIZED (
  SELECT *, {_sql_hashes("edited")} AS h2 FROM edits
), sketches AS MATERIALIZED (
  SELECT *, {_sql_sketch("h2")} AS s2 FROM edited_hashes
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(s1, '') AS fingerprint, array_to_string(s2, '') AS edited_fingerprint,
  {_sql_near("edited", "s2", "list_distinct(s1 || s2)")} AS near_edited, {_sql_near("next_text", "s3", "list_distinct(s1 || s3)")} AS near_next,
  {_sql_near("edited", "s2", "s1")} AS held_by_edited, {_sql_near("next_text", "s3", "s1")} AS held_by_next
FROM sketches
"""
