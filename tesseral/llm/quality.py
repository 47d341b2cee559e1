"""Quality by importance resampling.

Two bag-of-n-grams models over `BUCKETS` hashed word unigrams and bigrams, one
of target text and one of all raw text, give every document the log ratio of
its likelihoods; adding Gumbel noise seeded by the document and keeping the top
k draws k documents without replacement in proportion to those ratios.

The raw model counts all documents.  The target model is fitted on the
documents of at most `TARGET_ROWS` target ids, those with the least hash, and
that bound is what the driver sends to the executors.  k is a share of all
documents; the k-th key is found by counting ever finer ranges of the keys, so
no document list ever meets in one task.

Null, empty and wordless texts have no n-grams and a log weight of 0.  Rows that
repeat an id and a text have equal keys and are drawn together where k allows:
at the k-th key ties go to the least id, rows that still tie are all selected.
An id labelled twice is a target only if all its labels agree to it, and a row
without an id is none.  Without
targets all log weights are 0 and the draw is uniform.  An empty table gives an
empty one, and further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.kernels import U64, mix, word_hashes
from tesseral.llm.shared import materialise

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
KEEP_SHARE = 0.8


def ngrams(text: str | None) -> np.ndarray:
    """The buckets of the text's unigrams and bigrams."""
    words = word_hashes(text)
    pairs = mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])
    return (np.concatenate([words, pairs]) % U64(BUCKETS)).astype(np.int64)


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> list[int]:
    """At most `rows` ids labelled good and not toxic, those with the least hash."""
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("toxic").alias("toxic"))
    good = judged.where((F.col("good") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id").collect()]


def fit(docs: DataFrame, targets: list[int]) -> np.ndarray:
    """Log ratios of the target's to the raw model's bucket probabilities."""
    wanted = pa.array(sorted(targets), pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            known = pc.is_in(batch.column(0).cast(pa.int64()), value_set=wanted, skip_nulls=True).to_pylist()
            for first in range(0, batch.num_rows, 500):
                grams = [ngrams(t.as_py()) for t in batch.column(1)[first : first + 500]]
                raw += np.bincount(np.concatenate(grams), minlength=BUCKETS)
                good = [g for g, k in zip(grams, known[first:], strict=False) if k]
                if good:
                    target += np.bincount(np.concatenate(good), minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    rows = docs.select("doc_id", "text").mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.zeros((2, BUCKETS))
    for b, r, t in rows:
        counts[:, b] = r, t
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    smooth = counts + 1.0
    model = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return model[1] - model[0]


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, n_grams) of every row."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngrams(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(ratios[g].sum()) for g in grams], pa.float64()), pa.array([len(g) for g in grams], pa.int64())],
                names=["doc_id", "log_weight", "n_grams"],
            )

    return docs.select("doc_id", "text").mapInArrow(score, schema)


def gumbel(seed: int, *key: str) -> Column:
    """Standard Gumbel noise from a hash of the key's columns."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_greatest(rows: DataFrame, column: str, k: int, *, bins: int = 4096) -> float | None:
    """The k-th greatest value, by counting ever finer ranges of the values; the
    driver sees `bins` counts at a time.  None without rows or with k < 1."""
    lo, hi, n = rows.select(F.min(column), F.max(column), F.count(column)).head()
    if k < 1 or not n:
        return None
    if k >= n:
        return lo
    above = 0
    while lo < hi:
        step = (hi - lo) / bins
        inside = rows.where(F.col(column).between(lo, hi))
        place = F.least(F.floor((F.col(column) - lo) / step), F.lit(bins - 1)) if step > 0 else F.lit(0)
        parts = {r[0]: r[1:] for r in inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()}
        for b in sorted(parts, reverse=True):
            count, low, high = parts[b]
            if above + count >= k:
                break
            above += count
        if (low, high) == (lo, hi):
            return lo
        lo, hi = low, high
    return lo


def resample(docs: DataFrame, labels: DataFrame, *, share: float = KEEP_SHARE, seed: int = 0, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(doc_id, log_weight, n_grams, key, selected) of every row of (doc_id, text)."""
    ratios = fit(docs, target_ids(labels, target_rows))
    noisy = weigh(docs, ratios).withColumn("key", F.col("log_weight") + gumbel(seed, "doc_id"))
    keyed = materialise(noisy, "keys")
    n = keyed.count()
    k = round(share * n)
    least = kth_greatest(keyed, "key", k)
    if least is None:
        return keyed.withColumn("selected", F.lit(False))
    room = k - keyed.where(F.col("key") > least).count()
    tied = keyed.where(F.col("key") == least)
    last = kth_greatest(tied.select((-F.col("doc_id")).alias("doc_id")), "doc_id", room)
    tie = (F.col("key") == least) & (F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= -last, F.lit(False)))
    return keyed.withColumn("selected", (F.col("key") > least) | tie)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance weight, noisy key and draw of every document."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
