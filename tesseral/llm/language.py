"""Language identification by mixtures of n-gram models.

Training counts, for every language, the byte trigrams of the letter runs of
all training texts (A-Z lower-cased, edges marked), hashed into `BUCKETS`.  A
word's likelihood under a language is the product of its trigrams'; a document
is a mixture whose language proportions expectation-maximisation finds.  The
language set is chosen by penalised likelihood: from all languages down, the
one with the least proportion leaves as long as the log-likelihood less
`PENALTY` * ln(words) per language doesn't fall.  The prediction is the language
with the greatest proportion in the chosen set, its proportion is the score.

Null text, and text without a letter, is `und` with score 0 and no proportions,
and so is everything where no language could be learned.  Ties go to the lesser
language name.  Repeated rows are judged each for themselves, an empty table
gives an empty one, and further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.kernels import lowered

BITS = 15
BUCKETS = 1 << BITS
PENALTY = 2.0
#: Expectation-maximisation ends when a round gains less than GAIN, or after ROUNDS.
ROUNDS, GAIN = 1_000, 1e-3
#: Trigrams whose likelihoods are held at once.
BLOCK = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_ROW = 1 << 14


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all trigrams around a letter byte, and where words start among them."""
    data = lowered(text)
    letter = _LETTER[data]
    padded = np.full(len(data) + 2, 32, dtype=np.uint32)
    padded[1:-1] = np.where(letter, data, 32)
    code = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    buckets = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))[letter]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    return buckets, np.flatnonzero(first[letter])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def count_trigrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over all rows with a text and a language."""
    schema = "lang string, bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if has_letter(text):
                    total = seen.setdefault(lang.as_py(), np.zeros(BUCKETS, dtype=np.int64))
                    total += np.bincount(trigrams(text)[0], minlength=BUCKETS)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"]
            )

    texts = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    return texts.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods by bucket and language: BUCKETS rows, one column a language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32)

    def word_likelihoods(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The words' log-likelihoods, one column a language, a block of trigrams at a time."""
        out = np.zeros((len(starts), len(self.langs)))
        for a in range(0, len(buckets), BLOCK):
            b = min(a + BLOCK, len(buckets))
            first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
            out[first:last] += np.add.reduceat(self.table[buckets[a:b]], np.maximum(starts[first:last], a) - a, axis=0)
        return out

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """(language, proportion) of the chosen set, greatest first; empty for `und`."""
        if not self.langs or not has_letter(text):
            return []
        buckets, starts = trigrams(text)
        if not len(starts):
            return []
        words = self.word_likelihoods(buckets, starts)
        fine = PENALTY * np.log(len(words) + 1)
        single = words.sum(axis=0)
        best = int(np.argmax(single))
        # No mixture can beat every word's own best language.
        if words.max(axis=1).sum() - single[best] <= fine:
            return [(self.langs[best], 1.0)]
        chosen, (share, value) = np.arange(len(self.langs)), _em(words)
        while len(chosen) > 1:
            rest = np.delete(np.arange(len(chosen)), int(np.argmin(share)))
            less = _em(words[:, chosen[rest]])
            if less[1] < value - fine:
                break
            chosen, (share, value) = chosen[rest], less
        order = sorted(range(len(chosen)), key=lambda k: (-share[k], self.langs[chosen[k]]))
        return [(self.langs[chosen[k]], float(min(1.0, share[k]))) for k in order]


def _em(words: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of a mixture over word log-likelihoods."""
    top = words.max(axis=1, keepdims=True)
    relative = np.exp(words - top)
    share = np.full(words.shape[1], 1.0 / words.shape[1])
    value = -np.inf
    for _ in range(ROUNDS):
        weighted = relative * share
        total = weighted.sum(axis=1)
        now = float(np.log(total).sum())
        share = (weighted / total[:, None]).mean(axis=0)
        if now - value < GAIN:
            break
        value = now
    return share, now + float(top.sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on all rows given; the driver holds BUCKETS counts per language."""
    rows = count_trigrams(docs, text_col, lang_col).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        column = {x: k for k, x in enumerate(langs)}
        at = np.array([column[x] for x in rows["lang"].to_pylist()])
        counts[rows["bucket"].to_numpy(), at] = rows["n"].to_numpy()
    return Model(langs, counts)


MIXTURE = "array<struct<lang:string,share:double>>"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) of every row."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("languages", T._parse_datatype_string(MIXTURE))]
    )
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"lang": x, "share": p} for x, p in model.mixture(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=kind)], names=[id_col, "languages"])

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judge, schema)
    first = F.get("languages", F.lit(0))
    return out.select(id_col, F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"), F.coalesce(first["share"], F.lit(0.0)).alias("score"), "languages")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose leading language has a share of
    `least` or more; `und` rows go."""
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(m) and m[0][1] >= least for m in (model.mixture(t.as_py()) for t in batch.column(at))]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
