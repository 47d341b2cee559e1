"""N-gram Jaccard join by count vectors in R-trees.

A document's set is its distinct five-word shingles (with fewer words, the
whole sequence as one; without words, none).  Two documents link when
100 * intersection >= 80 * union of their sets; `components` gives every
document the least id that links reach from it.  The steps:

1. Every text is read for its set's size, its class (a hash of the whole set:
   copies share it) and its count vector: shingles hashed into a power of two
   of groups, about eight to a group, counted.  Shingles that many documents of
   a block share are counted too; the most frequent ones form a list of fixed
   length.
2. Every class is routed by its rarest shingles: linked sets share one of the
   first n - ceil(0.8 n) + 1 in any common order, and the order here is by hash
   with the frequent shingles last.  The documents of a shingle of the list that
   more than `BUCKET_ROWS` classes have are dealt to groups by set size (links
   need a ratio of 0.8, so a document is in two of them) and within a group to
   slices, each with some `HUBS` members of the group beside its own.
3. Buckets of the same classes are one.  In each the count vectors are the
   points of R-trees (one per vector length, packed by size and leading
   coordinates).  The sum of the coordinate minima of two vectors, or of a vector
   and a node's greatest coordinates, bounds the overlap from above; sub-trees
   and points below the overlap that a link needs are passed over.  The bucket's
   connected pairs leave as stars.  A bucket of no listed shingle that holds far
   more than `BUCKET_ROWS` classes is cut into slices too.  Mostly the hubs join
   the slices of a group; what lies outside its greatest component then meets all
   the rest of the group in pairs of slices.
4. Components of the surviving pairs are families.  Only families' texts move.
   A family is cut into slices of `FAMILY_SHINGLES`, each with `HUBS` members of
   the family beside its own, and every slice is verified exactly: a document is
   first held against the components' first members, then, where one is left
   open, against all others by shared shingles.  Mostly this joins the whole
   family, at one copy of each text.  Where it doesn't, what lies outside the
   family's greatest component meets all the rest in pairs of slices, so no link
   between different components is missed.
5. Components of the verified links, joined back to the documents by class.

Nothing here is capped or sampled: hot shingles, copies and families are split
and every link between different sets is found or implied by verified ones.
Shingles and classes are known by 64-bit hashes.

Null, empty and wordless texts have size 0 and are linked with nothing, not even
with each other.  Rows that repeat an id count as one document: what one of them
links to, all with words do.  A null id is none: a row without an id links no
others, and its component is that of its copies, if any.  An empty table gives
an empty one, and further columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.kernels import U64, mix, shingle_set
from tesseral.llm.shared import Forest, IdFilter, connected_components, discard, drop_ids, materialise

#: Frequent shingles kept, at most, and how often in a block makes one frequent.
HOT_SHINGLES, HOT_IN_BLOCK, BLOCK_SHINGLES = 65_536, 8, 1_000_000
#: Classes of one bucket slice; shingles of one family slice, and the members that all slices see.
BUCKET_ROWS, FAMILY_SHINGLES, HUBS = 1_000, 100_000, 8
MIN_GROUPS, MAX_GROUPS, PER_GROUP = 32, 4096, 8
#: Copies of a class that make it one of at most HOT_CLASSES that are sent to all tasks.
HOT_COPIES, HOT_CLASSES = 50_000, 100_000


def least_overlap(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """The least intersection with which sets of sizes a and b link."""
    return -(-4 * (a + b) // 9)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Counts by the leading bits of the hash; 255 stands for 255 or more."""
    groups = MIN_GROUPS
    while groups < MAX_GROUPS and groups * PER_GROUP < len(shingles):
        groups *= 2
    bits = groups.bit_length() - 1
    counts = np.bincount((shingles >> U64(64 - bits)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8)


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    """The counts of a shorter vector: neighbouring groups together."""
    wide = vectors.astype(np.int32)
    wide[vectors == 255] = 1 << 20
    return wide.reshape(*vectors.shape[:-1], groups, -1).sum(axis=-1)


class RTree:
    """Count vectors of one length, packed into leaves by size and leading
    coordinates, with inner nodes over runs of leaves.  A node knows the sizes
    it spans and its greatest count in each of MIN_GROUPS coordinates."""

    LEAF, FAN = 32, 16

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray):
        coarse = folded(vectors, MIN_GROUPS)
        order = np.lexsort((coarse[:, 1], coarse[:, 0], sizes))
        self.ids, self.sizes = ids[order], sizes[order]
        self.vectors, self.coarse = vectors[order], coarse[order]
        self.groups = vectors.shape[1]
        self.leaf_starts = np.arange(0, len(ids), self.LEAF)
        self.leaves = self._level(self.sizes, self.sizes, self.coarse, self.leaf_starts)
        self.node_starts = np.arange(0, len(self.leaf_starts), self.FAN)
        self.nodes = self._level(*self.leaves, self.node_starts)
        self.alive = np.ones(len(ids), dtype=bool)

    @staticmethod
    def _level(low: np.ndarray, high: np.ndarray, top: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(top, starts, axis=0)

    @staticmethod
    def _passes(level: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, size: int, coarse: np.ndarray) -> np.ndarray:
        low, high, top = (x[at] for x in level)
        near = (5 * high >= 4 * size) & (4 * low <= 5 * size)
        bound = np.minimum(top, coarse).sum(axis=1)
        return at[near & (bound >= least_overlap(size, np.maximum(low, -(-4 * size // 5))))]

    def take(self, size: int, vector: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        """Remove and return the places of all points that may link to this one."""
        leaves = _below(self._passes(self.nodes, np.arange(len(self.node_starts)), size, coarse), self.FAN, len(self.leaf_starts))
        points = _below(self._passes(self.leaves, leaves, size, coarse), self.LEAF, len(self.ids))
        points = points[self.alive[points]]
        if not len(points):
            return points
        groups = min(self.groups, len(vector))
        mine = folded(vector, groups)
        bound = np.minimum(folded(self.vectors[points], groups), mine).sum(axis=1)
        n = self.sizes[points]
        points = points[(5 * n >= 4 * size) & (4 * n <= 5 * size) & (bound >= least_overlap(size, n))]
        self.alive[points] = False
        return points


def _below(at: np.ndarray, fan: int, n: int) -> np.ndarray:
    """The places of the children of nodes."""
    out = (at[:, None] * fan + np.arange(fan)).ravel()
    return out[out < n]


def bucket_stars(ids: np.ndarray, sizes: np.ndarray, vectors: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs that connect what the overlap bound leaves connected in a bucket."""
    if len(ids) == 2:
        a, b = int(sizes[0]), int(sizes[1])
        if 5 * min(a, b) >= 4 * max(a, b):
            groups = min(len(vectors[0]), len(vectors[1]))
            if np.minimum(folded(vectors[0], groups), folded(vectors[1], groups)).sum() >= least_overlap(a, b):
                yield int(ids[0]), int(ids[1])
        return
    lengths = np.array([len(v) for v in vectors])
    trees = {}
    for groups in np.unique(lengths):
        mine = np.flatnonzero(lengths == groups)
        trees[int(groups)] = RTree(mine, sizes[mine], np.stack([vectors[k] for k in mine]))
    for tree in trees.values():
        for start in range(len(tree.ids)):
            if not tree.alive[start]:
                continue
            tree.alive[start] = False
            stack = [(tree, start)]
            root = int(ids[tree.ids[start]])
            while stack:
                of, at = stack.pop()
                size, vector, coarse = int(of.sizes[at]), of.vectors[at], of.coarse[at]
                for groups in (of.groups // 2, of.groups, of.groups * 2):
                    if other := trees.get(groups):
                        for p in other.take(size, vector, coarse):
                            yield root, int(ids[other.ids[p]])
                            stack.append((other, int(p)))


def _class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    total = mix(shingles).sum(dtype=U64) + U64(len(shingles))
    return int(mix(np.array([total], dtype=U64)).view(np.int64)[0])


def _few(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The rows in small batches, as a text's hashes are larger than the text."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of step 1: kind 0 documents, kind 1 frequent shingles (in cls) of a
    block, counted over the classes that are new to the task."""
    held: list[np.ndarray] = []
    amount, seen = 0, set()

    def frequent() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts >= HOT_IN_BLOCK
        n = int(many.sum())
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), none, pa.array(counts[many].astype(np.int64)), pa.array(values[many].view(np.int64)), pa.nulls(n, pa.binary())],
            names=["kind", "doc_id", "n", "cls", "vector"],
        )

    for batch in _few(batches):
        sets = [shingle_set(t.as_py()) for t in batch.column(1)]
        full = [len(s) > 0 for s in sets]
        classes = [_class_of(s) if f else None for s, f in zip(sets, full, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(len(sets), np.int32)),
                batch.column(0).cast(pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(classes, pa.int64()),
                pa.array([count_vector(s).tobytes() if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
            ],
            names=["kind", "doc_id", "n", "cls", "vector"],
        )
        for s, cls in zip(sets, classes, strict=True):
            if cls is None or cls in seen:
                continue
            seen.add(cls)
            held.append(s)
            amount += len(s)
            if amount >= BLOCK_SHINGLES:
                yield frequent()
                held, amount = [], 0
    if amount:
        yield frequent()


_STEP = U64(0x9E3779B97F4A7C15)
#: Links need a size ratio of 0.8, so linked sizes are in the same or in neighbouring bands.
_BAND = np.log(1.25) * (1 - 1e-9)


def _dealt(cls: int, size: int, shingles: np.ndarray, counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, groups) of a class for listed shingles that are cut into slices:
    its own slice of both its groups and, for a hub, all others of them too."""
    at = U64(cls & 0xFFFFFFFFFFFFFFFF)
    slices = (counts // most + 1).astype(U64)
    hub = mix(shingles ^ at).astype(np.float64) < HUBS / counts * 2.0**64
    band = int(np.log(size) / _BAND)
    for k in (band, band + 1):
        group = mix(shingles + U64(k + 1) * _STEP)
        yield mix(group + (at % slices + U64(1)) * _STEP), group
        for g, n in zip(group[hub], slices[hub], strict=True):
            yield mix(g + np.arange(1, n + U64(1), dtype=U64) * _STEP), np.full(int(n), g)


def _routes(hot: np.ndarray, counts: np.ndarray, most: int):
    """Step 2's scan, given the sorted frequent shingles and their counts: rows
    (bucket, cls, grp), with a grp only where the bucket is a slice of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _few(batches):
            buckets, owners, groups = [], [], []
            for text in batch.column(0):
                s = shingle_set(text.as_py())
                if not len(s):
                    continue
                cls = _class_of(s)
                if cls in seen:
                    continue
                seen.add(cls)
                chosen = s[: len(s) - (4 * len(s) + 4) // 5 + 1]
                if len(hot):
                    frequent = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    chosen = np.concatenate([s[~frequent], s[frequent]])[: len(chosen)]
                    at = np.minimum(np.searchsorted(hot, chosen), len(hot) - 1)
                    cut = (hot[at] == chosen) & (counts[at] > most)
                    if cut.any():
                        for bucket, group in _dealt(cls, len(s), chosen[cut], counts[at[cut]], most):
                            buckets.append(bucket)
                            groups.append(pa.array(group.view(np.int64)))
                            owners.append(np.full(len(bucket), cls, dtype=np.int64))
                        chosen = chosen[~cut]
                buckets.append(chosen)
                groups.append(pa.nulls(len(chosen), pa.int64()))
                owners.append(np.full(len(chosen), cls, dtype=np.int64))
            if buckets:
                columns = [pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.concatenate(owners)), pa.concat_arrays(groups)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "cls", "grp"])

    return scan


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by their first column."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if rest and rest[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        cut = int(np.searchsorted(key, key[-1], "left")) if key[0] <= key[-1] else 0
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _shared(most: int):
    """Step 3's scan of rows sorted by (bucket, cls)."""

    def rows(bucket: np.ndarray | None, cls: np.ndarray, group: np.ndarray | None) -> pa.RecordBatch:
        column = lambda x: pa.nulls(len(cls), pa.int64()) if x is None else pa.array(x)
        return pa.RecordBatch.from_arrays([column(bucket), pa.array(cls), column(group)], names=["bucket", "cls", "grp"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of buckets with two or more classes, under a hash of the
        bucket's classes in place of its shingle: near copies share many
        shingles, and buckets of the same classes need only one look.  Slices
        leave their group's members too, under a null bucket where the slice
        needs no look."""
        told: set[int] = set()
        for table in _runs(batches):
            bucket, cls = table.column(0).to_numpy(), table.column(1).to_numpy()
            sliced = ~np.asarray(table.column(2).is_null())
            group = table.column(2).fill_null(0).to_numpy()
            new = np.ones(len(bucket), dtype=bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (cls[1:] != cls[:-1])
            bucket, cls, group, sliced = bucket[new], cls[new], group[new], sliced[new]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
            members = mix(np.add.reduceat(mix(cls.view(U64)), starts) + sizes.astype(U64)).view(np.int64)
            fresh = np.zeros(len(starts), dtype=bool)
            for k in np.flatnonzero(sizes > 1):
                name = int(members[k])
                if name not in told:
                    told.add(name)
                    fresh[k] = True
            if len(told) > 1_000_000:
                told.clear()
            for k in np.flatnonzero(fresh & ~sliced[starts] & (sizes > 4 * most)):
                fresh[k] = False
                mine = cls[starts[k] : starts[k] + sizes[k]]
                yield rows(*_bucket_slices(members[k], mine, most))
            keep = np.repeat(fresh, sizes)
            for these, named, of in ((keep & ~sliced, True, False), (keep & sliced, True, True), (~keep & sliced, False, True)):
                if these.any():
                    yield rows(np.repeat(members, sizes)[these] if named else None, cls[these], group[these] if of else None)

    return scan


def _bucket_slices(name: np.int64, cls: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, cls, grp) of a bucket cut into slices that share its first HUBS classes."""
    k = len(cls) // most + 1
    mine = (cls[HUBS:].view(U64) % U64(k)).astype(np.int64)
    at = np.concatenate([mine, np.tile(np.arange(k), min(HUBS, len(cls)))])
    parts = mix(np.array([name]).view(U64) + (np.arange(k, dtype=U64) + U64(1)) * _STEP).view(np.int64)
    members = np.concatenate([cls[HUBS:], np.repeat(cls[:HUBS], k)])
    return parts[at], members, np.full(len(members), name)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of what the buckets connect, from rows (bucket, cls, n, vector) sorted by bucket."""
    found = Forest()
    for table in _runs(batches):
        bucket, cls, n = (table.column(k).to_numpy() for k in range(3))
        vectors = [np.frombuffer(v.as_py(), dtype=np.uint8) for v in table.column(3)]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                for pair in bucket_stars(cls[a:b], n[a:b], vectors[a:b]):
                    found.link(*pair)
        if found.full():
            yield found.stars()
    yield found.stars()


def linked_groups(sets: list[np.ndarray]) -> list[int]:
    """For each set the first set of its component under exact links."""
    m = len(sets)
    root = list(range(m))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def links(a: np.ndarray, b: np.ndarray) -> bool:
        if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            return False
        return len(np.intersect1d(a, b, assume_unique=True)) >= least_overlap(len(a), len(b))

    if m == 2:
        return [0, 0] if links(*sets) else [0, 1]
    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    _, token = np.unique(everything, return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(token, kind="stable")
    posted, starts = owner[order], np.searchsorted(token[order], np.arange(token.max() + 2))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    firsts: list[int] = []
    for q in range(m):
        for f in firsts if len(firsts) <= 8 else ():
            if find(f) != find(q) and links(sets[f], sets[q]):
                root[max(find(f), find(q))] = min(find(f), find(q))
        firsts = [f for f in firsts if find(f) == f]
        if any(find(f) != find(q) for f in firsts):
            mine = token[edges[q] : edges[q + 1]]
            lo, n = starts[mine], starts[mine + 1] - starts[mine]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            overlap = np.bincount(posted[at], minlength=m)[:q]
            for k in np.flatnonzero(overlap >= least_overlap(sizes[:q], sizes[q])):
                a, b = find(int(k)), find(q)
                root[max(a, b)] = min(a, b)
            firsts = [f for f in firsts if find(f) == f]
        if find(q) == q:
            firsts.append(q)
    return [find(k) for k in range(m)]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the links of family parts, from rows (part, doc_id, cls, text) sorted by part."""
    linked = Forest()
    for table in _runs(batches):
        part, doc, cls, text = (table.column(k) for k in range(4))
        part, doc, cls = part.to_numpy(), doc.to_numpy(), cls.to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a < 2:
                continue
            found: dict[int, tuple[int, np.ndarray]] = {}
            for k in range(a, b):
                s = shingle_set(text[k].as_py())
                if len(s) and _class_of(s) == cls[k]:
                    found.setdefault(int(cls[k]), (int(doc[k]), s))
            members = sorted(found.values(), key=lambda x: (len(x[1]), x[0]))
            if len(members) > 1:
                for k, r in enumerate(linked_groups([s for _, s in members])):
                    if r != k:
                        linked.link(members[k][0], members[r][0])
        if linked.full():
            yield linked.stars()
    yield linked.stars()


def _slice(k: str) -> Column:
    return F.pmod(F.xxhash64("cls"), F.col(k))


def _upto(k: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))


def _own_parts(sized: DataFrame) -> DataFrame:
    """(part, rep, cls): every member of a family of k slices in its slice, the
    HUBS members of least class in all of them."""
    own = sized.select(F.xxhash64("family", _slice("k")).alias("part"), "rep", "cls")
    place = F.row_number().over(Window.partitionBy("family").orderBy("cls"))
    hubs = sized.where("k > 1").withColumn("place", place).where(F.col("place") <= HUBS).select("family", "rep", "cls", _upto("k").alias("slice"))
    return own.unionByName(hubs.select(F.xxhash64("family", "slice").alias("part"), "rep", "cls"))


def _open_parts(state: DataFrame, most: int) -> DataFrame | None:
    """(part, and the columns of state but for family, component and n) for the
    families of (family, component, cls, n, ..) in several components; None if
    there are none.  What is outside a family's greatest component shares a part
    with every other member, members of that component needn't meet one another.
    A slice holds `most` by the sum of n."""
    rest = [c for c in state.columns if c not in ("family", "component", "n")]
    pieces = state.groupBy("family", "component").agg(F.sum("n").alias("n"))
    whole = pieces.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main")).where("n > main.n")
    slices = lambda n: F.ceil(n / F.lit(most)).cast("long")
    cuts = whole.select("family", F.col("main.component").alias("main"), slices(F.col("main.n")).alias("ka"), slices(F.col("n") - F.col("main.n")).alias("kb"))
    if cuts.isEmpty():
        return None
    rows = state.join(cuts, "family")
    inside, outside = rows.where("component = main"), rows.where("component != main")
    part = lambda a, b: F.xxhash64("family", a, b).alias("part")
    met = inside.select("*", _upto("kb").alias("b")).select(part(_slice("ka"), F.col("b")), *rest)
    meets = outside.select("*", _upto("ka").alias("a")).select(part(F.col("a"), _slice("kb")), *rest)
    pairs = outside.where("kb > 1").select("*", _upto("kb").alias("other"), _slice("kb").alias("mine")).where("other != mine")
    return met.unionByName(meets).unionByName(
        pairs.select(part(-1 - F.least("mine", "other"), F.greatest("mine", "other")), *rest)
    )


def _families(docs: DataFrame, found: DataFrame, vectors: DataFrame) -> DataFrame:
    """Steps 2 and 3: (cls, family) of what the overlap bound leaves connected."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequent = found.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "cls").limit(HOT_SHINGLES).toArrow()
    hot, counts = frequent["cls"].to_numpy().view(U64), frequent["n"].to_numpy()
    order = np.argsort(hot)
    names = "bucket long, cls long, grp long"
    routed = docs.select("text").mapInArrow(_routes(hot[order], counts[order], BUCKET_ROWS), names)
    shared = materialise(routed.repartition(parts, "bucket").sortWithinPartitions("bucket", "cls").mapInArrow(_shared(BUCKET_ROWS), names), "buckets")

    def stars(buckets: DataFrame) -> DataFrame:
        points = buckets.join(vectors, "cls").select("bucket", "cls", "n", "vector")
        return points.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_pairs, "a long, b long")

    families = materialise(connected_components(stars(shared.where("bucket IS NOT NULL").select("bucket", "cls").distinct())).toDF("cls", "family"), "families")
    groups = shared.where("grp IS NOT NULL").select(F.col("grp").alias("family"), "cls").distinct()
    if not groups.isEmpty():
        held = groups.join(families.select("cls", F.col("family").alias("component")), "cls", "left")
        state = materialise(held.select("family", "cls", F.coalesce("component", "cls").alias("component"), F.lit(1).alias("n")), "groups")
        still_open = _open_parts(state, BUCKET_ROWS)
        if still_open is not None:
            more = stars(still_open.withColumnRenamed("part", "bucket").distinct())
            families = materialise(connected_components(more.unionByName(families.toDF("a", "b"))).toDF("cls", "family"), "families")
        discard(state)
    discard(shared)
    return families


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, text): rows (doc_id, n, cls) and the classes' (cls, rep,
    copies, component); a class of null ids alone has no rep and no component."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(docs.mapInArrow(_features, "kind int, doc_id long, n long, cls long, vector binary"), "features")
    rows = found.where("kind = 0").drop("kind")
    worded = rows.where("cls IS NOT NULL")
    classes = worded.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    vectors = worded.groupBy("cls").agg(F.first("n").alias("n"), F.first("vector").alias("vector"))
    families = _families(docs, found, vectors)

    members = materialise(families.join(classes, "cls").where("rep IS NOT NULL").join(vectors.select("cls", "n"), "cls"), "members")
    total = members.groupBy("family").agg(F.ceil(F.sum("n") / FAMILY_SHINGLES).cast("long").alias("k"))
    sized = members.join(total, "family")

    def verified(of: DataFrame, dealt: DataFrame) -> DataFrame:
        texts = IdFilter(of.select("rep")).split(docs, "doc_id", True).join(dealt, F.col("doc_id") == F.col("rep"))
        return texts.select("part", "doc_id", "cls", "text").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_verified, "a long, b long")

    links = verified(members, _own_parts(sized))
    # Rows that repeat an id tie their classes together.
    texts_of = worded.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    double = worded.join(texts_of.where("low != high").select("doc_id"), "doc_id", "left_semi").select("doc_id", "cls").distinct()
    ties = double.join(classes, "cls").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = connected_components(links.unionByName(ties)).toDF("rep", "component")
    cut = sized.where("k > 1").join(joined, "rep", "left")
    state = materialise(cut.select("family", F.coalesce("component", "rep").alias("component"), "rep", "cls", "n"), "cut")
    still_open = _open_parts(state, FAMILY_SHINGLES)
    if still_open is not None:
        more = verified(still_open, still_open)
        joined = connected_components(more.unionByName(joined.toDF("a", "b"))).toDF("rep", "component")
    known = classes.join(joined, "rep", "left").select("cls", "rep", "copies", F.coalesce("component", "rep").alias("component"))
    return rows.drop("vector"), materialise(known, "classes")


def _placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with their class's component; null for those that have no other
    document in theirs.  Classes of very many copies, few by their definition,
    go to their rows; only rows of other classes move."""
    moved = known.where("copies > 1 OR component != rep").select("cls", "component", "copies")
    least = max(HOT_COPIES, rows.count() // HOT_CLASSES)
    hot = moved.where(F.col("copies") > least).drop("copies")
    if hot.isEmpty():
        return rows.join(moved.drop("copies"), "cls", "left")
    rest = rows.join(F.broadcast(hot.select("cls")), "cls", "left_anti").join(moved.where(F.col("copies") <= least).drop("copies"), "cls", "left")
    return rows.join(F.broadcast(hot), "cls").unionByName(rest)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    out = _placed(*_classified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which each component keeps one:
    a row of its least id.

    Of rows with words that repeat the id one stays, that of the least text.  A
    row without an id goes if it is a copy of one with an id; of copies that all
    lack an id one stays.  Rows without words stay, unless their id goes.
    """
    rows, known = _classified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    placed = materialise(_placed(rows, known).select("doc_id", "cls", "component"), "placed")
    gone = materialise(placed.where(F.col("component") != F.col("doc_id")).select("doc_id").distinct(), "gone")
    kept = drop_ids(docs, gone, id_col)
    double = placed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id").join(gone, "doc_id", "left_anti")
    double = materialise(double, "double")
    if double.isEmpty() and placed.where("doc_id IS NULL").isEmpty():
        return kept
    plain = drop_ids(kept.where(F.col(id_col).isNotNull()), double, id_col)
    maybe = IdFilter(double).split(kept.where(F.col(id_col).isNotNull()), id_col, True)
    odd = maybe.join(double.toDF("_double"), F.col(id_col) == F.col("_double"), "left_semi").unionByName(kept.where(F.col(id_col).isNull()))
    cls, place = f"_class_{uuid.uuid4().hex[:8]}", f"_place_{uuid.uuid4().hex[:8]}"
    named = odd.mapInArrow(_with_class(odd.columns.index(text_col), cls), T.StructType([*odd.schema.fields, T.StructField(cls, T.LongType())]))
    copied = known.where("component IS NOT NULL").select(F.col("cls").alias("_known"))
    worded = named.where(F.col(cls).isNotNull())
    ours = worded.where(F.col(id_col).isNotNull()).unionByName(
        worded.where(F.col(id_col).isNull()).join(copied, F.col(cls) == F.col("_known"), "left_anti")
    )
    same = Window.partitionBy(id_col, F.when(F.col(id_col).isNull(), F.col(cls))).orderBy(text_col)
    one = ours.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).drop(place)
    return plain.unionByName(one.unionByName(named.where(F.col(cls).isNull())).drop(cls))


def _with_class(at: int, name: str):
    """A scan that adds, as `name`, the class of the text in column `at`, null for wordless ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(t.as_py()) for t in batch.column(at))
            yield batch.append_column(name, pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()))

    return scan


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)::BIGINT), lambda i: array_to_string(w[i:i+4], ' ')))) END AS s
  FROM worded
), classes AS MATERIALIZED (
  SELECT s, min(doc_id) AS rep, row_number() OVER () AS c FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS MATERIALIZED (
  SELECT c, len(s) AS k, unnest(s) AS t FROM classes WHERE rep IS NOT NULL
), ids AS MATERIALIZED (
  SELECT DISTINCT s.doc_id, c.c FROM sets s JOIN classes c ON s.s = c.s WHERE s.doc_id IS NOT NULL
), links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c
  GROUP BY a.c, b.c, a.k, b.k HAVING 100*count(*) >= 80*(a.k + b.k - count(*))
  UNION
  SELECT a.c, b.c FROM ids a JOIN ids b ON a.doc_id = b.doc_id AND a.c <> b.c
), reached AS (
  SELECT c AS a, c AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (
  SELECT r.a AS c, min(i.doc_id) AS component_id FROM reached r LEFT JOIN ids i ON r.b = i.c GROUP BY r.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.s = c.s LEFT JOIN least l ON l.c = c.c
"""
