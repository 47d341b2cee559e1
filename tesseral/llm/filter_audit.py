"""Audit of filters in all their orders, by a stream that takes back what it said too early.

Five filters judge whole texts.  Four look at the text alone: A, under 50 words;
B, 100 * distinct words < 65 * words; C, 100 * `[A-Z]` characters > 5 * code
points; D, any of `#$%&*|`.  E fails a document whose text a smaller id has.

The files of the documents are the micro-batches of an available-now query.  A
batch's texts become masks of failed filters and digests; labels join by id; and
what a task holds of one text and part is one row of counts before it is
shuffled, so that a text of very many copies brings a row a task.  The state of
a text, known by its digest, is the least id so far and how many rows of each
part have it; the states of some TEXTS texts share a key, as a call a text takes
some milliseconds.  Rows above the least id count as failing E.  When a smaller id
comes, the rows that held the least id until then are retracted from the
counters of their masks and counted again with E; the counters' changes of each
batch are written once under its number, so a repeated batch changes nothing.
Sums of the changes are the numbers of documents by part, mask and label, and
all orders and steps follow from these.

Null texts are empty, null parts are the empty string.  A row without an id has
no smaller id and is none.  Rows that share the least id all pass E.  An id with
several labels is good (toxic) if any of them says so.  An empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesseral.llm.kernels import U64, span_hashes, word_spans
from tesseral.llm.shared import delete, discard, materialise, new_path, settings

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
#: Micro-batches that the files are dealt to, at most.
BATCHES = 6
#: Texts whose states share a key, on average: the number of keys grows with the rows, a state doesn't.
TEXTS = 256
#: Rows of a label, so that one id of very many documents meets it in as many tasks.
SALTS = 8
#: Rows of a micro-batch that meet their labels in one task, about.
MEETING = 100_000
#: Bytes of text whose words are told apart at once; distinct keys that a task holds.
BLOCK, HELD = 4 << 20, 100_000
#: Settings of the query's state: on disk, of bounded memory an executor, changes only for each batch, nothing allocated ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}

_SYMBOL, _SPACE, _CAPITAL = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|")] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CAPITAL[65:91] = True


def text_mask(text: bytes) -> int:
    """The bits of the filters A to D (1, 2, 4, 8) that a UTF-8 text fails, a block of it at a time."""
    words = capitals = points = start = 0
    symbol, distinct = False, np.zeros(0, dtype=U64)
    while start < len(text):
        end = min(len(text), start + BLOCK)
        while end < len(text) and not _SPACE[text[end]]:  # a word isn't cut
            rest = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - end), end)])
            end = end + int(rest[0]) if len(rest) else min(len(text), end + BLOCK)
        data = np.frombuffer(text, np.uint8, end - start, start)
        hashes = span_hashes(data, *word_spans(data))
        words += len(hashes)
        distinct = np.unique(np.concatenate([distinct, hashes]))
        capitals += int(_CAPITAL[data].sum())
        points += int(((data & 0xC0) != 0x80).sum())
        symbol |= bool(_SYMBOL[data].any())
        start = end
    return (words < MIN_WORDS) | (100 * len(distinct) < MIN_DISTINCT * words) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | symbol << 3


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
        columns = [
            batch.column(0), batch.column(2),
            pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
            pa.array([text_mask(t) for t in texts], pa.int32()), pa.array(np.arange(n, n + len(texts)) % SALTS, pa.int32()),
        ]
        n += len(texts)
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "mask", "salt"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for what a task holds of a text: for each part and label how many
    rows, their least id, and how many have it; rows without an id on their own."""
    held: dict[tuple, dict] = {}

    def rows() -> pa.RecordBatch:
        digest, mask = zip(*held, strict=True) if held else ([], [])
        owned = [json.dumps([[*key, *seen] for key, seen in x.items()]) for x in held.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(mask, pa.int32()), pa.array(owned, pa.string())], names=["digest", "mask", "held"])

    for batch in batches:
        for doc_id, digest, part, mask, label in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            seen = held.setdefault((digest, mask), {}).setdefault((part, label, doc_id is None), [doc_id, 0, 0])
            if doc_id is not None and doc_id < seen[0]:
                seen[:2] = doc_id, 0
            seen[1] += doc_id == seen[0]
            seen[2] += 1
        if len(held) >= HELD:
            yield rows()
    yield rows()


COMBINED = "digest binary, mask int, held string"
CHANGES = "part string, mask int, label int, n long"
DUPLICATE = 1 << FILTERS.index("E")


class Texts:
    """Of each text of a bucket the least id so far and how many rows of a part
    and label have it; `changes` gathers what new rows change in the counters."""

    def __init__(self, stored: str = "{}"):
        self.texts = json.loads(stored)
        self.changes: dict[tuple, int] = {}

    def stored(self) -> str:
        return json.dumps(self.texts)

    def _add(self, part: str, mask: int, label: int, n: int) -> None:
        if n:
            self.changes[part, mask, label] = self.changes.get((part, mask, label), 0) + n

    def see(self, text: str, mask: int, rows: list) -> None:
        """rows: [part, label, without an id, least id, rows that have it, rows]."""
        least, owners = self.texts.get(text, (None, []))
        for part, label, nameless, now, at_least, n in rows:
            if nameless:
                self._add(part, mask, label, n)
                continue
            if least is None or now < least:
                for p, x, k in owners:
                    self._add(p, mask, x, -k)
                    self._add(p, mask | DUPLICATE, x, k)
                least, owners = now, []
            if now == least:
                owners = [*owners, [part, label, at_least]]
                self._add(part, mask, label, at_least)
                n -= at_least
            self._add(part, mask | DUPLICATE, label, n)
        if least is not None:
            together: dict[tuple, int] = {}
            for p, x, k in owners:
                together[p, x] = together.get((p, x), 0) + k
            self.texts[text] = (least, [[p, x, k] for (p, x), k in together.items()])


def _retract(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of the counters that a batch's rows of a bucket of texts bring."""
    texts = Texts(*state.get) if state.exists else Texts()
    for frame in frames:
        for digest, mask, held in zip(frame["digest"].tolist(), frame["mask"].tolist(), frame["held"].tolist(), strict=True):
            texts.see(digest.hex(), mask, json.loads(held))
    state.update((texts.stored(),))
    rows = [(*k, n) for k, n in texts.changes.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "label", "n"]).astype({"mask": "int32", "label": "int32", "n": "int64"})


def stream_changes(docs: DataFrame, labels: DataFrame, buckets: int, meetings: int = 1) -> DataFrame:
    """The changes of counters (part, mask, label, n) by a stream of (doc_id, text, source);
    label: 1 for good, 2 for toxic, added.  Labels grow with the documents, so both are dealt
    by id over `meetings` tasks; a broadcast would hold all labels, SALTS times, in the driver."""
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).cast("int").alias("label"))
    salted = flags.where("label > 0").withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    measured = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part")).mapInArrow(_measured, "doc_id long, part string, digest binary, mask int, salt int")
    # Rows without an id have no label; a number of their own keeps them apart.
    named = measured.withColumn("_id", F.coalesce("doc_id", F.xxhash64("digest", "salt"))).withColumn("_known", F.col("doc_id").isNotNull())
    known = salted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_known"), "salt", "label")
    # Not by _known, a constant of the labels that the join no longer has as a key.
    dealt = [x.repartition(meetings, "_id", "salt") for x in (named, known)]
    met = dealt[0].join(dealt[1].hint("merge"), ["_id", "_known", "salt"], "left")
    marked = met.select("doc_id", "digest", "part", "mask", F.coalesce("label", F.lit(0)).alias("label"))
    combined = marked.mapInArrow(_combined, COMBINED)
    keyed = combined.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(_retract, CHANGES, "texts string", "update", GroupStateTimeout.NoTimeout)


def counters(spark: SparkSession, documents: str, labels: DataFrame, *, batches: int = BATCHES) -> DataFrame:
    """(part, mask, label, n) of the Parquet files of a path, read as a stream."""
    static = spark.read.parquet(documents)
    files = -(-len(static.inputFiles()) // batches)
    path = documents.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern, as a stream takes the name of a single file for a folder's
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", max(1, files)).option("maxFileAge", "36500d").parquet(path)
    changes, checkpoint = new_path(spark, "changes"), new_path(spark, "audit")
    kept = materialise(labels.select("doc_id", "quality", "toxic"), "labels")
    written = []

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "label").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{changes}/batch={number}")
        written.append(number)

    rows = static.count()
    meetings = max(spark.sparkContext.defaultParallelism, -(-rows // (batches * MEETING)))
    with settings(spark, STATE):
        query = stream_changes(stream, kept, max(1, rows // TEXTS), meetings).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    delete(spark, checkpoint)
    discard(kept)
    rows = spark.read.schema(CHANGES).parquet(changes) if written else spark.createDataFrame([], CHANGES)
    return rows.groupBy("part", "mask", "label").agg(F.sum("n").alias("n")).where("n <> 0")


def _steps() -> list[tuple[int, int, list[tuple[str, int]]]]:
    """(filter's bit, bits of those before it, the orders and steps where that is so)."""
    out: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(FILTERS):
        before = 0
        for k, x in enumerate(order):
            bit = 1 << FILTERS.index(x)
            out.setdefault((bit, before), []).append(("".join(order), k + 1))
            before |= bit
    return [(bit, before, where) for (bit, before), where in out.items()]


def audit(counted: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its documents by mask and label.

    A part is one row of numbers by mask; what a filter removes depends only on
    the set of filters before it, 80 cases, each of which stands for its orders."""
    size = 1 << len(FILTERS)
    by_mask = lambda what: F.array(*(F.coalesce(F.sum(F.when((F.col("mask") == m) & what, F.col("n"))), F.lit(0)) for m in range(size)))
    parts = counted.groupBy("part").agg(
        by_mask(F.lit(True)).alias("all"), by_mask(F.col("label").bitwiseAND(1) > 0).alias("good"), by_mask(F.col("label").bitwiseAND(2) > 0).alias("toxic")
    )
    cases = _steps()
    literal = F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before, _ in cases))
    orders = F.array(*(F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in where)) for _, _, where in cases))
    rows = parts.select("part", "all", "good", "toxic", F.posexplode(literal).alias("case", "c")).withColumn("at", F.get(orders, F.col("case")))

    def total(numbers: str, holds, weight=None):
        each = [(m, F.when(holds(m), F.get(numbers, F.lit(m)) * (weight[m] if weight else 1)).otherwise(0)) for m in range(size)]
        out = each[0][1]
        for _, x in each[1:]:
            out = out + x
        return out.cast("long")

    bit, before = F.col("c.bit"), F.col("c.before")
    fails = lambda m: F.lit(m).bitwiseAND(bit) > 0
    out_before = lambda m: F.lit(m).bitwiseAND(before) > 0
    # Of the 120 orders of five filters, a filter is first among k of them in 120 / k.
    shares = [120 // max(1, bin(m).count("1")) for m in range(size)]
    numbers = rows.select(
        "part", "at",
        total("all", lambda m: ~fails(m) & ~out_before(m)).alias("kept"),
        total("all", lambda m: fails(m) & ~out_before(m)).alias("removed"),
        total("all", lambda m: fails(m) & out_before(m)).alias("redundant"),
        total("all", lambda m: bit == m).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~out_before(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~out_before(m)).alias("toxic_lost"),
        total("all", fails, shares).alias("shapley"),
    )
    kinds = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return numbers.select("part", F.explode("at").alias("at"), *kinds).select("part", "at.filter_order", "at.step", *kinds)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(counters(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP11_SQL = """
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM words LEFT JOIN flags USING (doc_id)
),
counted AS (SELECT part, good, toxic, fails, count(*) AS n FROM masks GROUP BY ALL),
five AS (SELECT unnest(range(1, 6)) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM five a, five b, five c, five d, five e
  WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f
),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: chr((64 + x)::INT)), '') AS filter_order, step, o[step] AS f, o[1:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)),
judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failing, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) AS failed
  FROM counted, steps
),
out_ AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER (NOT failing AND NOT gone) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed, sum(n) FILTER (failing AND gone) AS redundant,
    sum(n) FILTER (failing AND failed = 1) AS unique_fails, sum(n) FILTER (failing AND NOT gone AND good = 1) AS good_lost, sum(n) FILTER (failing AND NOT gone AND toxic = 1) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM out_
"""
