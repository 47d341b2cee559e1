"""What the operators of this subpackage share: tables in the shared folder,
and connected components of an edge table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir.  Where that is unset, a
    session in one machine (as in tests) uses a folder in its warehouse, and a
    cluster's is an error, as its machines may not share any other folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends
    there, so a lost executor costs only the tasks that were running on it."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete a table of materialise() that nothing will read again."""
    path = getattr(df, "_written_to", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the jobs run meanwhile."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: one row (node, component) for each
    node of an edge, component being the least node of its component.

    Alternating star contraction on DataFrames: every large-star step links a
    node's greater neighbours to its least one, every small-star step its
    smaller ones; both keep the components and the number of rounds grows with
    the logarithm of the longest path.  It ends when all edges are stars, which
    needs no round where they are stars to begin with.  A minimum by node has a map-side
    combine, and a node with very many neighbours meets its minimum by a join
    that adaptive execution may split, so no neighbour list is ever built.
    Null ends and loops are ignored; an empty table gives an empty one.
    """
    pairs = (
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    current = materialise(pairs, "cc")
    while _unfinished(current):
        # Large star: every greater neighbour of u joins the least of u and its neighbours.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where(F.col("b") > F.col("a"))
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b"))
        )
        # Small star: with all edges pointing down, u and its smaller neighbours join the
        # least.  Repeated edges, no more than there were before, go at its end.
        large = materialise(large, "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(joined.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        nxt = materialise(small, "cc")
        discard(large)
        discard(current)
        current = nxt
    # Both steps keep every node, so the stars hold them all.
    centres = current.select(F.col("b").alias("node")).distinct()
    out = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(centres.select("node", F.col("node").alias("component")))


def _unfinished(edges: DataFrame) -> bool:
    """Whether downward edges aren't yet stars: a node has two lesser neighbours,
    or one and a greater one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    degree = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not degree.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1))).isEmpty()


class Forest:
    """Components of the links that one task finds, for at most `most` nodes at a
    time: they leave as stars around their least nodes, so that what a task has
    joined needs no contraction round.  Links to nodes of an earlier block are
    joined by connected_components."""

    def __init__(self, most: int = 200_000):
        self.most, self.up = most, {}

    def _root(self, k: int) -> int:
        up = self.up
        while (above := up.setdefault(k, k)) != k:
            up[k] = k = up[above]
        return k

    def link(self, a: int, b: int) -> None:
        a, b = self._root(a), self._root(b)
        self.up[max(a, b)] = min(a, b)

    def full(self) -> bool:
        return len(self.up) >= self.most

    def stars(self) -> pa.RecordBatch:
        """The rows (a, b) of the block, b the least node of a's component; it ends here."""
        rows = [(k, r) for k in self.up if (r := self._root(k)) != k]
        self.up = {}
        a, b = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: Bits of an id filter by member, and at most: 32 MB, good for some 30 million members.
BITS_BY_MEMBER, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 28


class IdFilter:
    """A bit table of hashed ids: never misses a member, and lets about one in
    BITS_BY_MEMBER others by, or one in eight at its greatest size.  Of more
    members than that size serves there is no table, and all rows pass."""

    def __init__(self, ids: DataFrame):
        """ids: a single column, of any type."""
        known = ids.where(F.col(ids.columns[0]).isNotNull())
        members = known.count()
        self.bits, self.size = None, MIN_BITS
        while self.size < min(MAX_BITS, BITS_BY_MEMBER * members):
            self.size *= 2
        if members > MAX_BITS // 8:
            return
        at = self.place(ids.columns[0])
        words = known.select(F.floor(at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bits"))
        rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(self.size // 64, dtype=np.int64)
        table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        self.bits = table

    def place(self, name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.size))

    def hits(self, at: np.ndarray) -> np.ndarray:
        """Which of these places may be a member's."""
        if self.bits is None:
            return np.ones(len(at), dtype=bool)
        return (self.bits[at >> 6] >> (at & 63)) & 1 == 1

    def split(self, df: DataFrame, id_col: str, hits: bool) -> DataFrame:
        """The rows whose id may be a member, or those whose id is certainly none."""
        if self.bits is None:
            return df if hits else df.where(F.lit(False))
        schema = df.schema

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(self.hits(at) == hits))

        named = df.select("*", self.place(id_col).alias(f"_filter_{uuid.uuid4().hex[:8]}"))
        return named.mapInArrow(choose, schema)


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """df without the rows whose id is in `ids` (a single column): only rows
    that an IdFilter lets by are moved to meet the ids."""
    known = ids.toDF("_gone")
    members = IdFilter(known)
    maybe = members.split(df, id_col, True)
    kept = maybe.join(known, maybe[id_col] == known["_gone"], "left_anti")
    return members.split(df, id_col, False).unionByName(kept)
