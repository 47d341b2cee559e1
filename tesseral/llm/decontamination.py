"""Benchmark decontamination by greedy string tiling.

Words here are runs of letters and digits (any non-ASCII byte counts as one),
A-Z lower-cased, so that punctuation and line breaks inside a copied passage
change nothing.  A document and a test item that share a run of `min_match`
words meet by the run's rolling (Karp-Rabin) hash.  Of such a pair, tiles are
taken greedily: again and again the longest match that overlaps no tile in
either text, ties by the earliest place in the item, then in the document.  The
share of the item's words under tiles is its coverage, whatever order its
passages stand in; pairs of `threshold` or more are contaminated.  An item with
fewer words than `min_match` is matched as a whole.

The items are the stated query set: they are cut into blocks of `block_words`
words on average, each block goes to all executors and passes over the whole
texts once, so what is sent at once is bounded however large the benchmark is.

Null and empty texts or items match nothing; repeated document rows are judged
each for themselves, repeated items are one per row; empty tables give empty
results (or, for drop_contaminated, the documents as they are); further columns
are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.kernels import U64, lowered, shingle_hashes, span_hashes

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True

MIN_MATCH, THRESHOLD, BLOCK_WORDS = 5, 0.5, 1_000_000


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the words without punctuation."""
    if not text:
        return np.zeros(0, dtype=U64)
    data = lowered(text)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[data]
    step = np.diff(inside)
    return span_hashes(data, np.flatnonzero(step == 1), np.flatnonzero(step == -1))


#: Pairs of equal seeds that are listed at once; more are walked through along the item.
PAIRS = 2_000_000


def listed_runs(item_at: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, item place, document place) of all maximal diagonal runs of seed pairs."""
    order = np.lexsort((item_at, doc_at - item_at))
    i, d = item_at[order], doc_at[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(d) != 1)]))
    return np.diff(np.concatenate([new, [len(i)]])), i[new], d[new]


def walked_runs(places: np.ndarray, found: list[np.ndarray], doc_seeds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, from the document places of each item place in order: only one
    item place's run lengths are held, whatever the number of pairs."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    before, last = np.zeros(doc_seeds + 1, dtype=np.int64), -1
    for i, at in [*zip(places.tolist(), found, strict=True), (None, None)]:
        now = np.zeros(doc_seeds + 1, dtype=np.int64)
        if i is not None:
            now[at] = 1
            if i == last + 1:
                now[at] += np.where(at > 0, before[at - 1], 0)
        goes_on = now[1:] > 1 if i is not None and i == last + 1 else np.zeros(doc_seeds, dtype=bool)
        ended = np.flatnonzero((before[:-1] > 0) & ~goes_on)
        if len(ended):
            n = before[ended]
            out.append((n, last - n + 1, ended - n + 1))
        before, last = now, i
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def tile(doc_words: int, item_words: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray], size: int) -> list[tuple[int, int, int]]:
    """Tiles (length, item place, document place) from runs of seeds of `size` equal words."""
    heap = [(-(n + size - 1), i, d) for n, i, d in zip(*(x.tolist() for x in runs), strict=True)]
    heapq.heapify(heap)
    item_free, doc_free = np.ones(item_words, dtype=bool), np.ones(doc_words, dtype=bool)
    tiles, left = [], item_words
    while heap and left >= size:
        length, a, b = heapq.heappop(heap)
        length = -length
        free = item_free[a : a + length] & doc_free[b : b + length]
        if free.all():
            item_free[a : a + length] = doc_free[b : b + length] = False
            tiles.append((length, a, b))
            left -= length
            continue
        edge = np.diff(np.concatenate([[0], free.astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if e - s >= size:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return tiles


class Index:
    """The seeds of a block of items: sorted hashes behind a fixed-size bit table."""

    BITS = 20

    def __init__(self, items: list[tuple[object, np.ndarray]], min_match: int):
        self.items = items
        #: Items by seed length: min_match, or less for items that are shorter.
        self.tables = []
        by_size: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(items):
            if len(words):
                by_size.setdefault(min(min_match, len(words)), []).append(k)
        for size, members in sorted(by_size.items()):
            seeds = [shingle_hashes(items[k][1], size) for k in members]
            hashes = np.concatenate(seeds)
            owner = np.repeat(np.array(members), [len(s) for s in seeds])
            place = np.concatenate([np.arange(len(s)) for s in seeds])
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << self.BITS, dtype=bool)
            table[(hashes >> U64(64 - self.BITS)).astype(np.int64)] = True
            self.tables.append((size, hashes[order], owner[order], place[order], table))

    def matches(self, text: str | None, threshold: float) -> Iterator[tuple[object, int, int, int]]:
        """(item id, tiles, covered words, item words) of every contaminated item."""
        words = plain_words(text)
        for size, hashes, owner, place, table in self.tables:
            if len(words) < size:
                continue
            own = shingle_hashes(words, size)
            at = np.flatnonzero(table[(own >> U64(64 - self.BITS)).astype(np.int64)])
            seeds, which = np.unique(own[at], return_inverse=True)
            lo, hi = np.searchsorted(hashes, seeds, "left"), np.searchsorted(hashes, seeds, "right")
            n = hi - lo
            if not n.any():
                continue
            order = np.argsort(which, kind="stable")
            times = np.bincount(which, minlength=len(seeds))
            begin = np.cumsum(times) - times
            met = np.repeat(np.arange(len(seeds)), n)
            row = np.arange(len(met)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            for k in np.unique(owner[row]):
                mine = owner[row] == k
                seed, item_at = met[mine], place[row[mine]]
                name, item = self.items[k]
                found = lambda s: at[order[begin[s] : begin[s] + times[s]]]  # noqa: E731, B023
                if times[seed].sum() <= PAIRS:
                    runs = listed_runs(np.repeat(item_at, times[seed]), np.concatenate([found(s) for s in seed]))
                else:
                    along = np.argsort(item_at)
                    runs = walked_runs(item_at[along], [found(s) for s in seed[along]], len(own))
                tiles = tile(len(words), len(item), runs, size)
                covered = sum(t[0] for t in tiles)
                if covered >= threshold * len(item):
                    yield name, len(tiles), covered, len(item)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, min_match: int, least_words: int = 1) -> Iterator[Index]:
    """The benchmark's items of least_words or more in blocks that fit the bound on average."""
    words = F.coalesce(F.regexp_count(text_col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = benchmark.select(F.sum(words)).head()[0] or 0
    n = -(-total // block_words)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id").collect()
        words_of = [(r.id, plain_words(r.text)) for r in block]
        yield Index([x for x in words_of if len(x[1]) >= least_words], min_match)


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, item id, n_tiles, covered, item_words, coverage) of the contaminated pairs."""
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(item_col, benchmark.schema[item_col].dataType),
            T.StructField("n_tiles", T.LongType()),
            T.StructField("covered", T.LongType()),
            T.StructField("item_words", T.LongType()),
            T.StructField("coverage", T.DoubleType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def scan(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for name, text in zip(batch.column(0), batch.column(1), strict=True):
                    for item, n, covered, size in index.matches(text.as_py(), threshold):
                        found.append((name.as_py(), item, n, covered, size, covered / size))
                columns = list(zip(*found, strict=True)) or [()] * len(shape)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        return over

    texts = docs.select(F.col(id_col), F.col(text_col))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, item_col, item_text_col, block_words, min_match):
        out = out.unionByName(texts.mapInArrow(scan(index), schema))
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, short_items: bool = False,
) -> DataFrame:
    """The documents, with all their columns, that hold no contaminated item.

    Items of fewer than min_match words, which occur by chance, condemn none
    unless short_items says so; contaminated_pairs() reports them either way."""
    at = docs.columns.index(text_col)

    def scan(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(index.matches(t.as_py(), threshold), None) is None for t in batch.column(at)]
                yield batch.filter(pa.array(clean, type=pa.bool_()))

        return over

    out = docs
    for index in _blocks(benchmark, item_col, item_text_col, block_words, min_match, 1 if short_items else min_match):
        out = out.mapInArrow(scan(index), docs.schema)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated pairs of documents and benchmark items."""
    return contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
