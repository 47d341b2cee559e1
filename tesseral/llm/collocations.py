"""Phrase collocations: frequent phrases of two to four words and how firmly they hold.

A text is lower-cased (A-Z), split at `.,;:!?` and line ends into pieces, and
those at spaces and tabs into words.  A word with its language is a 64-bit token
(equal words of two languages are two tokens), a phrase the hash of its tokens;
everything counts phrases by these hashes.  Level by level, for 2, 3 and 4 words:

1. bounds: occurrences whose two shorter parts are frequent are counted by a
   32-bit bucket of their hash, which no phrase of the bucket can exceed;
2. candidates: the distinct phrases whose parts are frequent and whose bucket
   reaches the least count (Apriori-safe: nothing frequent is left out);
3. counts: the candidates, in shards of about SHARD phrases, become double-array
   tries.  Up to BROADCASTS of them are broadcast; a task moves the states of all its text
   positions through the trie at once, counts the accepting states, and the
   tasks' counts are summed.  More of them, as a pass over the texts for each would grow with the
   square of the input, are built where they are needed: one pass deals the occurrences of
   candidates, equal ones of a task together, to their shard's task, which moves them through its trie.

Which parts are frequent, and which buckets are, is known from bit tables of at
most MAX_BITS bits; beyond that size they let more candidates by, never fewer.
So what is broadcast is bounded, and more candidates mean more shards, not more passes.

Null texts count as empty, null languages as `und`.  Repeated rows count again.
Ids and further columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.llm.double_array import DoubleArray
from tesseral.llm.kernels import _LOWER, U64, mix, span_hashes
from tesseral.llm.shared import discard, materialise, settings

LEAST, LONGEST, TOP = 30, 4, 2_000
#: Candidates of one trie; tries of a level that are broadcast, each for a pass over the texts.
SHARD, BROADCASTS = 250_000, 3
#: Bytes of text that are cut into words at once; words, hashes and phrases that a task holds before it passes them on.
BLOCK, WORDS, HASHES, PHRASES = 1 << 18, 150_000, 1_000_000, 300_000
#: Rows of tokens are large: batches of them are bounded by bytes.  What a task
#: passes on is what it has seen, once; so tasks read much, and small files together.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.files.openCostInBytes": "256k",
}
BITS_BY_MEMBER, MIN_BITS, MAX_BITS = 256, 1 << 16, 1 << 28
#: Slices of a language when its best phrases are chosen.
SLICES = 16

_BREAK, _OUTSIDE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_OUTSIDE[list(b".,;:!?\n\x0b\x0c\r \t")] = True
_FACTORS = mix(np.arange(2001, 2001 + 16, dtype=U64)) | U64(1)


def _blocks(data: bytes, most: int | None = None) -> Iterator[bytes]:
    """The text in blocks of about `most` bytes that end at a piece's end, so that
    no phrase is cut; a longer piece is a block of its own."""
    most, start = most or BLOCK, 0
    while len(data) - start > most:
        at = np.flatnonzero(_BREAK[np.frombuffer(data, np.uint8, most, start)])
        end = start + most
        if len(at):
            end = start + int(at[-1]) + 1
        else:
            while end < len(data) and not _BREAK[data[end]]:
                step = np.flatnonzero(_BREAK[np.frombuffer(data, np.uint8, min(most, len(data) - end), end)])
                end = end + int(step[0]) if len(step) else min(len(data), end + most)
        yield data[start:end]
        start = end
    yield data[start:]


def _language(lang: str) -> np.uint64:
    data = np.frombuffer(f"{lang} ".encode(), dtype=np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0]


def tokens_of(data: np.ndarray, lang: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: the words' tokens, where they start and end, and which begin a piece."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_OUTSIDE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    tokens = mix(span_hashes(data, starts, ends) + lang)
    tokens[tokens == 0] = 1
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts] if len(starts) else starts
    first = np.ones(len(starts), dtype=bool)
    first[1:] = piece[1:] != piece[:-1]
    return tokens, starts, ends, first


def _apart(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The tokens with a 0 before each that is marked."""
    out = np.zeros(len(tokens) + int(first.sum()) + 1, dtype=U64)
    out[np.arange(len(tokens)) + np.cumsum(first)] = tokens
    return out


class _Words:
    """The distinct words of a task's texts with their counts."""

    def __init__(self):
        self.token, self.n = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        self.word, self.lang = np.zeros(0, dtype=object), np.zeros(0, dtype=object)

    def add(self, tokens: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray, lang: str) -> None:
        token, at, n = np.unique(tokens, return_index=True, return_counts=True)
        place = np.searchsorted(self.token, token)
        known = np.zeros(len(token), dtype=bool)
        inside = place < len(self.token)
        known[inside] = self.token[place[inside]] == token[inside]
        self.n[place[known]] += n[known]
        fresh = at[~known]
        word = np.empty(len(fresh), dtype=object)
        word[:] = [data[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
        where = place[~known]
        self.token = np.insert(self.token, where, token[~known])
        self.n = np.insert(self.n, where, n[~known])
        self.word = np.insert(self.word, where, word)
        self.lang = np.insert(self.lang, where, np.full(len(fresh), lang, dtype=object))

    def rows(self) -> pa.RecordBatch:
        out = _encoded_row(None, self.token, self.lang, self.word, self.n)
        self.__init__()
        return out


ENCODED = "tokens binary, token long, lang string, word string, n long"


def _encoded_row(tokens: np.ndarray | None, token=(), lang=(), word=(), n=()) -> pa.RecordBatch:
    blob = [tokens.tobytes()] if tokens is not None else [None] * len(token)
    none = [None] * len(blob) if tokens is not None else None
    columns = [
        pa.array(blob, pa.binary()),
        pa.array(none if tokens is not None else np.asarray(token).view(np.int64), pa.int64()),
        pa.array(none or list(lang), pa.string()), pa.array(none or list(word), pa.string()), pa.array(none if tokens is not None else n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["tokens", "token", "lang", "word", "n"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: `tokens` of some text, pieces parted by 0; and the words with their counts."""
    words = _Words()
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str, held=held, size=size) -> pa.RecordBatch:
            joined = b"\n".join(held.pop(lang))
            size.pop(lang)
            data = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
            tokens, starts, ends, first = tokens_of(data, _language(lang))
            words.add(tokens, data.tobytes(), starts, ends, lang)
            return _encoded_row(_apart(tokens, first))

        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for block in _blocks((text.as_py() or "").encode("utf-8", "surrogatepass")):
                held.setdefault(lang, []).append(block)
                size[lang] = size.get(lang, 0) + len(block)
                if size[lang] >= BLOCK:
                    yield flush(lang)
                    if len(words.token) >= WORDS:
                        yield words.rows()
        for lang in list(held):
            yield flush(lang)
    yield words.rows()


def _windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """The hashes of the runs of `size` tokens that start at each position; a word's is its token."""
    n = max(0, len(tokens) - size + 1)
    if size == 1:
        return tokens
    total = np.zeros(n, dtype=U64)
    for k in range(size):
        total += tokens[k : n + k] * _FACTORS[k]
    return mix(total + U64(size))


class Bits:
    """A bit table of hashes: never misses a member."""

    def __init__(self, hashes: DataFrame):
        """hashes: a single column of longs."""
        name = hashes.columns[0]
        members, size = hashes.count(), MIN_BITS
        while size < min(MAX_BITS, BITS_BY_MEMBER * members):
            size *= 2
        place = F.pmod(F.col(name), F.lit(size))
        word, bit = F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit")
        rows = hashes.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        self.mask, self.table = U64(size - 1), np.zeros(size // 64, dtype=U64)
        self.table[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(U64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return ((self.table[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).astype(bool)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(32)).astype(np.uint32)


def _safe(tokens: np.ndarray, size: int, parts: Bits) -> np.ndarray:
    """Where phrases of `size` words start whose two parts of one word less may be frequent."""
    if len(tokens) < size:
        return np.zeros(0, dtype=np.int64)
    ok = parts.has(_windows(tokens, size - 1))
    whole = tokens != 0
    for k in range(size - 1):
        ok &= whole[k : len(ok) + k]
    return np.flatnonzero(ok[:-1] & ok[1:])


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column(0):
            yield np.frombuffer(row.as_buffer(), dtype=U64)


def _bounds(size: int, parts) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            bucket, count = np.unique(np.concatenate(held) if held else np.zeros(0, dtype=np.uint32), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int32)), pa.array(count, pa.int64())], names=["bucket", "n"])

        for tokens in _token_rows(batches):
            found = _bucket(_windows(tokens, size)[_safe(tokens, size, parts.value)])
            held.append(found)
            n += len(found)
            if n >= HASHES:
                yield rows()
                n = 0
        yield rows()

    return scan


def _names(size: int) -> list[str]:
    return [f"w{k}" for k in range(size)]


def _schema(size: int) -> str:
    return ", ".join(f"{w} long" for w in _names(size))


def _candidates(size: int, parts, heavy) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, more, n = np.zeros(0, dtype=U64), np.zeros((0, size), dtype=U64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, first = np.unique(np.concatenate([grams, *(g for g, _ in more)]), return_index=True)
            out = np.concatenate([words, *(w for _, w in more)])[first]
            more.clear()
            return found, out

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(size)], names=_names(size))

        for tokens in _token_rows(batches):
            at = _safe(tokens, size, parts.value)
            found = _windows(tokens, size)[at]
            hit = heavy.value.has(_bucket(found).astype(U64))
            found, first = np.unique(found[hit], return_index=True)
            more.append((found, np.stack([tokens[at[hit][first] + k] for k in range(size)], axis=1)))
            n += len(found)
            if n >= PHRASES:
                (grams, words), n = merged(), 0
                if len(grams) >= PHRASES:
                    yield rows()
                    grams, words = np.zeros(0, dtype=U64), np.zeros((0, size), dtype=U64)
        grams, words = merged()
        yield rows()

    return scan


def _hashed(size: int) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([c.to_numpy().view(U64) for c in batch.columns], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(_gram_of(words).view(np.int64)), *batch.columns], names=["gram", *_names(size)])

    return scan


def _counts(trie) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(trie.value.keys), dtype=np.int64)
        for tokens in _token_rows(batches):
            total += trie.value.count(tokens)
        at = np.flatnonzero(total)
        gram = _gram_of(trie.value.keys[at])
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(total[at])], names=["gram", "n"])

    return scan


DEALT = "shard int, kind int, words binary, n binary"


def _dealt_row(shard: int, words: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
    """A shard's candidates (kind 0), or occurrences of them with their counts (kind 1)."""
    columns = [pa.array([shard], pa.int32()), pa.array([int(n is not None)], pa.int32()), pa.array([words.tobytes()], pa.binary()), pa.array([None if n is None else n.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DEALT.split(", ")])


def _by_shard(grams: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = ((grams >> U64(16)) % U64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _dealt_candidates(shards: int) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([c.to_numpy().view(U64) for c in batch.columns], axis=1)
            for k, at in _by_shard(_gram_of(words), shards):
                yield _dealt_row(k, words[at], None)

    return scan


def _dealt_occurrences(size: int, parts, heavy, shards: int) -> callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            grams, words, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(grams, kind="stable")
            grams = grams[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            return grams[first], words[order[first]], np.add.reduceat(n[order], first)

        def rows() -> Iterator[pa.RecordBatch]:
            grams, words, n = held.pop()
            for k, at in _by_shard(grams, shards):
                yield _dealt_row(k, words[at], n[at])

        fresh = 0
        for tokens in _token_rows(batches):
            at = _safe(tokens, size, parts.value)
            found = _windows(tokens, size)[at]
            hit = heavy.value.has(_bucket(found).astype(U64))
            found, first, n = np.unique(found[hit], return_index=True, return_counts=True)
            held.append((found, np.stack([tokens[at[hit][first] + k] for k in range(size)], axis=1), n.astype(np.int64)))
            fresh += len(found)
            if fresh >= PHRASES:
                held.append(together())
                fresh = 0
                if len(held[0][0]) >= HASHES:
                    yield from rows()
        if held:
            held.append(together())
            yield from rows()

    return scan


def _dealt_counts(size: int) -> callable:
    """Rows by shard, each one's candidates first: the candidates with their counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, trie, total = None, [], None, np.zeros(0, dtype=np.int64)

        def rows() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            gram = _gram_of(trie.keys[at]) if trie else np.zeros(0, dtype=U64)
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(total[at])], names=["gram", "n"])

        for batch in batches:
            for r in range(batch.num_rows):
                shard, words = batch.column(0)[r].as_py(), np.frombuffer(batch.column(2)[r].as_buffer(), dtype=U64).reshape(-1, size)
                if shard != current:
                    yield rows()
                    current, keys, trie, total = shard, [], None, np.zeros(0, dtype=np.int64)
                if batch.column(1)[r].as_py() == 0:
                    keys.append(words.copy())
                    continue
                if trie is None:
                    if not keys:
                        continue  # no phrase of this shard is a candidate
                    trie = DoubleArray(np.concatenate(keys))
                    keys, total = [], np.zeros(len(trie.keys), dtype=np.int64)
                n, key = np.frombuffer(batch.column(3)[r].as_buffer(), dtype=np.int64), trie.find(words)
                total += np.bincount(key[key >= 0], weights=n[key >= 0], minlength=len(total)).astype(np.int64)
        yield rows()

    return scan


def _counted_by_shard(texts: DataFrame, candidates: DataFrame, size: int, parts, heavy, shards: int) -> DataFrame:
    """(gram, n) of all candidates: their occurrences meet their shard's trie in one task."""
    keys = candidates.select(*_names(size)).mapInArrow(_dealt_candidates(shards), DEALT)
    met = keys.unionByName(texts.mapInArrow(_dealt_occurrences(size, parts, heavy, shards), DEALT))
    return met.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_dealt_counts(size), "gram long, n long")


def _gram_of(words: np.ndarray) -> np.ndarray:
    """The hashes of phrases, one a row of tokens."""
    if words.shape[1] == 1:
        return words[:, 0]
    total = np.zeros(len(words), dtype=U64)
    for k in range(words.shape[1]):
        total += words[:, k] * _FACTORS[k]
    return mix(total + U64(words.shape[1]))


def _shorter(parts) -> callable:
    """Rows of tokens cut down to the positions of triples whose pairs may be frequent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _token_rows(batches):
            at = _safe(tokens, 3, parts.value)
            keep = np.zeros(len(tokens) + 1, dtype=bool)
            for k in range(3):
                keep[at + k] = True
            linked = np.zeros(len(tokens) + 1, dtype=bool)  # to the token before
            linked[at + 1] = linked[at + 2] = True
            left = np.flatnonzero(keep)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array([_apart(tokens[left], ~linked[left]).tobytes()], pa.binary())], names=["tokens"])

    return scan


def frequent_phrases(texts: DataFrame, size: int, parts: Bits, least: int = LEAST, shard: int | None = None) -> DataFrame:
    """(gram, w0 .., n) of the phrases of `size` words that occur `least` times or
    more in rows of tokens; parts: the frequent phrases of one word less."""
    spark, shard = texts.sparkSession, shard or SHARD
    sent = spark.sparkContext.broadcast(parts)
    bounds = texts.mapInArrow(_bounds(size, sent), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    many = materialise(bounds.where(F.col("n") >= least).select(F.pmod(F.col("bucket").cast("long"), F.lit(1 << 32)).alias("bucket")), "buckets")
    heavy = spark.sparkContext.broadcast(Bits(many))
    discard(many)
    found = texts.mapInArrow(_candidates(size, sent, heavy), _schema(size)).distinct()
    candidates = materialise(found.mapInArrow(_hashed(size), f"gram long, {_schema(size)}"), "candidates")
    shards = -(-candidates.count() // shard)
    counted = spark.createDataFrame([], "gram long, n long")
    if shards > BROADCASTS:
        # Smaller tries, as a task takes long to build one.
        counted = materialise(_counted_by_shard(texts, candidates, size, sent, heavy, 4 * shards).where(F.col("n") >= least), "counted")
    for k in range(shards if shards <= BROADCASTS else 0):
        rows = candidates.where(F.pmod("gram", F.lit(shards)) == k).drop("gram").toArrow()
        trie = spark.sparkContext.broadcast(DoubleArray(np.stack([c.to_numpy().view(U64) for c in rows.columns], axis=1)))
        seen = texts.mapInArrow(_counts(trie), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        part = materialise(seen.where(F.col("n") >= least), "counted")
        counted = part if not k else counted.unionByName(part)
        trie.destroy()
    for x in (sent, heavy):
        x.destroy()
    out = materialise(candidates.join(counted, "gram").select("gram", *_names(size), "n"), "phrases")
    discard(candidates)
    return out


PARTS = "gram long, size int, words array<long>, a long, firsts array<long>, rests array<long>, inside array<long>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases with the hashes of the two parts of every cut, and of the shorter phrases inside."""

    def lists(columns: list[np.ndarray], n: int) -> pa.ListArray:
        flat = np.stack(columns, axis=1).view(np.int64).ravel() if columns else np.zeros(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(columns)), pa.array(flat))

    for batch in batches:
        words = np.stack([batch.column(k).to_numpy().view(U64) for k in range(1, batch.num_columns - 1)], axis=1)
        n, size = words.shape
        firsts = [_gram_of(words[:, :k]) for k in range(1, size)]
        rests = [_gram_of(words[:, k:]) for k in range(1, size)]
        inside = [_gram_of(words[:, s : s + k]) for k in range(2, size) for s in range(size - k + 1)]
        columns = [batch.column(0), pa.array(np.full(n, size, dtype=np.int32)), lists([words[:, k] for k in range(size)], n), batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, lists(firsts, n), lists(rests, n), lists(inside, n)], names=[x.split()[0] for x in PARTS.split(", ")])


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, words, a, l, r, score) of the phrases that no longer one stands for;
    counts: (gram, f) of all frequent words and phrases."""
    cuts = phrases.select("gram", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "cut")).select("gram", "a", "k", "cut.firsts", "cut.rests")
    both = cuts.join(counts.select(F.col("gram").alias("firsts"), F.col("f").alias("l")), "firsts").join(counts.select(F.col("gram").alias("rests"), F.col("f").alias("r")), "rests")
    score = F.expr("(cast(a AS decimal(19,0)) * 2000000) div (cast(l AS decimal(19,0)) + r)")
    best = both.withColumn("score", score).groupBy("gram").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("gram", "b.l", "b.r", "b.score")
    longer = phrases.select("a", F.explode("inside").alias("gram")).groupBy("gram").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, "gram", "left").where(F.col("longer").isNull() | F.expr("100 * cast(longer AS decimal(19,0)) < 80 * cast(a AS decimal(19,0))"))
    return kept.select("gram", "words", "a").join(best, "gram")


def _counted(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int, shard: int | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Frequent words, words by language, phrases with their parts, and the counts of both."""
    texts = docs.select(F.col(text_col).alias("t"), F.coalesce(F.col(lang_col), F.lit("und")).alias("l"))
    encoded = materialise(texts.mapInArrow(_encode, ENCODED), "tokens")
    words = encoded.where(F.col("word").isNotNull())
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    vocabulary = materialise(words.groupBy("token").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    rows = encoded.where(F.col("tokens").isNotNull()).select("tokens")
    counts, found, parts, short = vocabulary.select(F.col("token").alias("gram"), F.col("n").alias("f")), None, Bits(vocabulary.select("token")), None
    for size in range(2, longest + 1):
        level = frequent_phrases(rows, size, parts, least, shard)
        parts = Bits(level.select("gram"))
        if size == 2:
            sent = docs.sparkSession.sparkContext.broadcast(parts)
            short = rows = materialise(rows.mapInArrow(_shorter(sent), "tokens binary"), "shorter")
            sent.destroy()
        counts = counts.unionByName(level.select("gram", F.col("n").alias("f")))
        more = level.mapInArrow(_parts, PARTS)
        found = more if found is None else found.unionByName(more)
    phrases = materialise(found, "phrases")
    discard(short)
    discard(encoded)
    return vocabulary, totals, phrases, counts


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, shard: int | None = None) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all collocations."""
    with settings(docs.sparkSession, SETTINGS):
        vocabulary, totals, phrases, counts = _counted(docs, text_col, lang_col, least, longest, shard)
    kept = scored(phrases, counts)
    spelt = kept.select("gram", F.posexplode("words").alias("k", "token")).join(vocabulary.select("token", "lang", "word"), "token")
    named = spelt.groupBy("gram").agg(F.min("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"])).alias("phrase"))
    out = kept.join(named, "gram").join(totals, "lang")
    return out.select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first `top` by score, count and phrase, with their rank.
    Slices of a language choose first, so that no task gets all of it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = found.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    few = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS k, array_to_string(ws[i:i+{k - 1}], ' ') AS p FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM pieces WHERE len(ws) >= {k})" for k in range(1, LONGEST + 1)
)
OP12_SQL = f"""
WITH lowered AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM lowered)),
f AS (SELECT lang, k, p, count(*) AS n FROM ({_GRAMS}) GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, p, n AS a, string_split(p, ' ') AS w FROM f WHERE k >= 2 AND n >= {LEAST}),
cuts AS (SELECT lang, p, a, k, w, unnest(range(1, k)) AS c FROM cand),
halves AS (
  SELECT c.lang, c.p, c.a, c.c, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = array_to_string(c.w[1:c.c], ' ') JOIN f y ON y.lang = c.lang AND y.p = array_to_string(c.w[c.c+1:c.k], ' ')
),
low AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
inner_ AS (SELECT lang, a, array_to_string(w[s:s+m-1], ' ') AS p FROM (SELECT lang, a, k, w, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT lang, a, k, w, unnest(range(2, k)) AS m FROM cand WHERE k > 2))),
longer AS (SELECT lang, p, max(a) AS longest FROM inner_ GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM low JOIN total USING (lang) LEFT JOIN longer USING (lang, p)
WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a
QUALIFY rank <= {TOP}
"""
