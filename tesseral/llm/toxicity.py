"""Toxicity by a convolutional text classifier, trained in NumPy.

Words (A-Z lower-cased) are hashed into an embedding table; filters of several
widths slide over the embedded words, the greatest answer of each filter over
the whole text is kept, and a linear layer makes a logit of these.  As only the
greatest answers count, a step of training changes only the windows that gave
them.  Embeddings start from how far a word's document frequency among toxic
texts departs from chance, words never seen in training stay at zero, and Adam
or (for the embeddings) Adagrad does the rest.

The thresholds are calibrated by language: on rows that the training didn't use,
each language gets the logit with the best F1, or that of all rows where it has
too few of either label.  A text's language is guessed from its own words by a
model of the training rows' languages.  The score is the logistic function of
the logit less the threshold, so 0.5 is the threshold of every language.

All labelled rows teach it.  Their words are dealt by a hash of id and text into
parts of about PART_WORDS words.  In each round every part trains a copy of the
model on its own rows, and the copies are averaged, an embedding over the parts
that changed it; the counts, the languages and the thresholds are sums over the
parts.  A round's loss is that of a fifth of all rows, chosen by hash, which no
part trains on; the same rows choose the thresholds.  Where either share lacks a
label, all rows do both.  Each sum is of multiples of one power of two, so
neither the order of the parts nor the layout of the table changes it.  Words
move once, 18 bits each; sums move as compressed slices of rows.  Texts of any
length are read whole, a block of words at a time.

Null and wordless texts have no window, and what the linear layer says of none.
An id labelled toxic once is toxic; labels without an id or a value aren't used,
nor are rows without a text; rows that repeat an id and a text teach once.  Without examples of both labels every score is the
one label seen, 0 if there is none.  Repeated rows are scored each for
themselves, an empty table gives an empty one, and further columns are not
looked at.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.kernels import U64, mix, word_hashes
from tesseral.llm.shared import IdFilter, discard, materialise, settings

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
#: Words that one copy of the model is trained on in a round, about.
PART_WORDS = 1 << 21
EPOCHS, BATCH, PATIENCE, RATE, DECAY = 12, 32, 3, 0.01, 1e-4
#: Words that filters slide over at once.
BLOCK = 1 << 16
#: Examples of either label that a language's own threshold needs.
EXAMPLES = 20
#: Thresholds lie between places of asinh(logit), which no logit exceeds in size.
PLACES, MOST = 1024, 90
_LANG_BUCKETS = 1 << 16
_TAIL = max(WIDTHS) - 1
#: Bits after the point of an embedding's change, as many as float32 has below 1; rows of a sum that move together.
CHANGE_BITS, SLICE = 24, 1 << 15


def word_buckets(text: str | None) -> np.ndarray:
    return (word_hashes(text) % U64(BUCKETS)).astype(np.int32)


def press_words(words: np.ndarray) -> bytes:
    """Word buckets in 18 bits each: the low 16, then the high two of four words a byte."""
    high = np.zeros(-(-len(words) // 4) * 4, dtype=np.uint8)
    high[: len(words)] = words >> 16
    high = high.reshape(-1, 4)
    return words.astype("<u2").tobytes() + (high[:, 0] | high[:, 1] << 2 | high[:, 2] << 4 | high[:, 3] << 6).tobytes()


def unpress_words(body: bytes | pa.Buffer, n: int) -> np.ndarray:
    low = np.frombuffer(body, dtype="<u2", count=n).astype(np.int32)
    high = np.frombuffer(body, dtype=np.uint8, offset=2 * n)
    return low | (np.stack([high >> k & 3 for k in (0, 2, 4, 6)], axis=1).ravel()[:n].astype(np.int32) << 16)


def press_rows(at: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Ascending places and their rows of doubles, compressed byte by byte of a number, as like bytes compress best."""
    parts = np.diff(at, prepend=0).astype("<i4"), np.ascontiguousarray(rows.T, dtype="<f8").ravel()
    planes = [plane for x in parts for plane in x.view(np.uint8).reshape(len(x), -1).T]
    return [pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True) for x in planes]


def unpress_rows(bodies: list[bytes], n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    def numbers(own: list[bytes], size: int, kind: str) -> np.ndarray:
        planes = [np.frombuffer(pa.decompress(x, size, codec="zstd"), dtype=np.uint8) for x in own]
        return np.stack(planes, axis=1).view(kind).ravel()

    return np.cumsum(numbers(bodies[:4], n, "<i4")), numbers(bodies[4:], n * width, "<f8").reshape(width, n).T


class Classifier:
    """The parameters, and the scores of texts given as word buckets."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embedding = np.zeros((BUCKETS + 1, DIM), dtype=np.float32)  # the last is the padding behind a text
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0] = np.abs(f[0, 0]) * np.where(np.arange(FILTERS) % 2, -1, 1)
        self.offsets = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.weights = np.where(np.arange(len(WIDTHS) * FILTERS) % 2, -0.1, 0.1).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self.langs: list[str] = []
        self.lang_table = np.zeros((_LANG_BUCKETS, 0), dtype=np.float32)
        self.thresholds = np.zeros(1)  # of the languages, and last of all rows
        self.constant: float | None = None

    def answers(self, padded: np.ndarray) -> np.ndarray:
        """Of each position with _TAIL more behind it, what each filter answers there."""
        n, width = len(padded) - _TAIL, max(WIDTHS)
        flat = np.zeros((width, DIM, len(WIDTHS), FILTERS), dtype=np.float32)
        for j, f in enumerate(self.filters):
            flat[: len(f), :, j] = f
        each = self.embedding[padded]
        windows = np.concatenate([each[k : n + k] for k in range(width)], axis=1)
        out = windows @ flat.reshape(width * DIM, -1)
        out += self.offsets
        return out

    def peaks(self, texts: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest answer of each filter, a text a row, 0 at least; and the first place of it, where asked for."""
        out = np.zeros((len(texts), len(WIDTHS) * FILTERS), dtype=np.float32)
        at = np.zeros(out.shape, dtype=np.int64) if places else None
        pad = np.full(_TAIL, BUCKETS, dtype=np.int32)
        owners, offsets, parts, size = [], [], [], 0

        def flush() -> None:
            nonlocal size
            # Each part is followed by the words behind it, at which no window of its own starts.
            lengths = np.array([len(p) - _TAIL for p in parts])
            starts = np.concatenate([[0], np.cumsum(lengths + _TAIL)[:-1]])
            found = self.answers(np.concatenate([*parts, pad]))
            if places:
                for i, offset, start, n in zip(owners, offsets, starts, lengths, strict=True):
                    own = found[start : start + n]
                    place = own.argmax(axis=0)
                    best = own[place, np.arange(own.shape[1])]
                    better = best > out[i]
                    out[i][better] = best[better]
                    at[i][better] = offset + place[better]
            else:
                edges = np.stack([starts, starts + lengths], axis=1).ravel()
                np.maximum.at(out, owners, np.maximum.reduceat(found, edges, axis=0)[::2])
            for x in (owners, offsets, parts):
                x.clear()
            size = 0

        for i, words in enumerate(texts):
            for a in range(0, len(words), BLOCK):
                part = words[a : a + BLOCK + _TAIL]
                short = min(len(words) - a, BLOCK) + _TAIL - len(part)
                owners.append(i)
                offsets.append(a)
                parts.append(np.concatenate([part, pad[:short]]) if short else part)
                size += len(part)
                if size >= BLOCK:
                    flush()
        if parts:
            flush()
        return out, at

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """The greatest answer of each filter, a text a row; 0 at least."""
        return self.peaks(texts)[0]

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.pooled(texts).astype(np.float64) @ self.weights.astype(np.float64) + float(self.bias[0])

    def languages(self, texts: list[np.ndarray]) -> np.ndarray:
        """The place of each text's likeliest language; past the last one for all other languages and without a word."""
        none = len(self.langs)
        if not none:
            return np.zeros(len(texts), dtype=np.int64)
        out = np.full(len(texts), none)
        for i, words in enumerate(texts):
            total = np.zeros(self.lang_table.shape[1])
            for a in range(0, len(words), BLOCK):
                total += self.lang_table[words[a : a + BLOCK] & (_LANG_BUCKETS - 1)].sum(axis=0, dtype=np.float64)
            if len(words):
                out[i] = int(np.argmax(total))
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.logits(texts) - self.thresholds[self.languages(texts)]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _odds(count: np.ndarray, among: np.ndarray, share: float) -> np.ndarray:
    """How far each bucket's document frequency among toxic texts departs from
    chance, in standard deviations; what may well be chance counts as none."""
    z = (among - share * count) / np.sqrt(share * (1 - share) * count + 1)
    z[count < 5] = 0
    return np.sign(z) * np.log1p(np.maximum(np.abs(z) - 2, 0))


def _step(model: Classifier, texts: list[np.ndarray], toxic: np.ndarray, state: dict) -> None:
    """One step on a batch: Adam on filters and weights, Adagrad on the embeddings of the windows that answered most."""
    pad = np.full(_TAIL, BUCKETS, dtype=np.int32)
    parts = [np.concatenate([x, pad]) for x in texts]
    joined = np.concatenate([*parts, pad])
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    pooled, places = model.peaks(texts, True)
    at = starts[:, None] + places
    live = pooled > 0
    logit = pooled @ model.weights + model.bias[0]
    error = ((1 / (1 + np.exp(-np.clip(logit, -60, 60))) - toxic) / len(texts)).astype(np.float32)
    back = error[:, None] * model.weights * live
    grads = {"weights": pooled.T @ error + DECAY * model.weights, "bias": error.sum(keepdims=True), "offsets": back.sum(axis=0)}
    rows, slopes = [], []
    for j, w in enumerate(WIDTHS):
        own = slice(j * FILTERS, (j + 1) * FILTERS)
        grad = np.zeros_like(model.filters[j])
        for k in range(w):
            words = joined[at[:, own] + k]
            grad[k] = np.einsum("bfd,bf->df", model.embedding[words], back[:, own])
            rows.append(words.ravel())
            slopes.append((back[:, own, None] * model.filters[j][k].T[None]).reshape(-1, DIM))
        grads[f"filter{j}"] = grad + DECAY * model.filters[j]
    state["t"] = t = state.get("t", 0) + 1
    for name, grad in grads.items():
        value = model.filters[int(name[6:])] if name.startswith("filter") else getattr(model, name)
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    rows, slopes = np.concatenate(rows), np.concatenate(slopes)
    own, back_to = np.unique(rows, return_inverse=True)
    total = np.zeros((len(own), DIM), dtype=np.float32)
    np.add.at(total, back_to, slopes)
    total[own == BUCKETS] = 0
    seen = state.setdefault("seen", np.zeros(BUCKETS + 1, dtype=np.float32))
    seen[own] += (total * total).mean(axis=1)
    model.embedding[own] -= 0.5 * RATE * total / (np.sqrt(seen[own])[:, None] + 1e-6)


def best_threshold(logits: np.ndarray, toxic: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The cut with the best F1, halfway between two logits; of equal ones the widest gap's.
    Where `rows` counts the rows of each logit, `toxic` counts the toxic ones."""
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], toxic[order]
    hits, taken = np.cumsum(y), np.cumsum(np.ones(len(z)) if rows is None else rows[order])
    f1 = 2 * hits / (taken + y.sum())
    gap = np.append(z[:-1] - z[1:], 1.0)
    f1[gap <= 0] = -1
    k = int(np.lexsort((-gap, -f1))[0])
    return float(z[k] - gap[k] / 2)


class Part(NamedTuple):
    """Rows that one copy of the model trains on; those of `checks` only choose the round and the thresholds."""

    number: int
    texts: list[np.ndarray]
    toxic: np.ndarray
    checks: np.ndarray
    langs: list[str | None]

    def train(self, shared: bool) -> list[int]:
        return [i for i, x in enumerate(self.texts) if len(x) and (shared or not self.checks[i])]

    def test(self, shared: bool) -> list[int]:
        return [i for i in range(len(self.texts)) if shared or self.checks[i]]


#: Adds up what a function of (what is sent, parts) finds, arrays of the shape, over all parts.
Sums = Callable[[Callable[[Any, Iterator[Part]], np.ndarray], Any, tuple[int, int]], np.ndarray]


def _count(_: Any, parts: Iterator[Part]) -> np.ndarray:
    """Document frequencies of the buckets, and last the rows with and without
    words: of rows to train on, of toxic ones, of checks and of toxic ones."""
    out = np.zeros((BUCKETS + 2, 4))
    for part in parts:
        for words, y, check in zip(part.texts, part.toxic, part.checks, strict=True):
            own = np.append(np.unique(words), BUCKETS if len(words) else BUCKETS + 1)
            out[own, 2 * int(check)] += 1
            out[own, 2 * int(check) + 1] += y
    return out


def _count_languages(langs: list[str], parts: Iterator[Part]) -> np.ndarray:
    """Words of each language by bucket, all other languages last."""
    out, place = np.zeros((_LANG_BUCKETS, len(langs) + 1)), {x: k for k, x in enumerate(langs)}
    for part in parts:
        by: dict[int, list[np.ndarray]] = {}
        for words, lang in zip(part.texts, part.langs, strict=True):
            if lang is not None:
                by.setdefault(place.get(lang, len(langs)), []).append(words)
        for k, texts in by.items():
            out[:, k] += np.bincount(np.concatenate(texts) & (_LANG_BUCKETS - 1), minlength=_LANG_BUCKETS)
    return out


def _dense(model: Classifier, state: dict) -> list[np.ndarray]:
    """All parameters but the embeddings, and Adam's averages of them."""
    values = {"weights": model.weights, "bias": model.bias, "offsets": model.offsets} | {f"filter{j}": f for j, f in enumerate(model.filters)}
    return [x for name, value in values.items() for x in (value, *state.setdefault(name, (np.zeros_like(value), np.zeros_like(value))))]


def _exact(x: np.ndarray, bits: int = 40) -> np.ndarray:
    """x in multiples of a power of two, whose sums don't depend on the order."""
    return np.ldexp(np.rint(np.ldexp(x, bits)), -bits)


def _round_shape(model: Classifier) -> tuple[int, int]:
    """An embedding a row, then all else that a round adds up, as many in a row."""
    size = 4 + sum(x.size for x in _dense(model, {}))
    return BUCKETS + 1 + -(-size // (DIM + 2)), DIM + 2


def _round(sent: tuple[Classifier, dict, bool, int, int], parts: Iterator[Part]) -> np.ndarray:
    """A round: the loss of the model, and what training on each part makes of
    it: changes of embeddings and of their Adagrad sums with the number of parts
    that made them; then loss, checks, parts trained, steps and the values of _dense."""
    base, known, shared, seed, number = sent
    out = np.zeros(_round_shape(base))
    rest = out[BUCKETS + 1 :].reshape(-1)
    for part in parts:
        test = part.test(shared)
        z, y = base.logits([part.texts[i] for i in test]), part.toxic[test]
        rest[0] += _exact((np.logaddexp(0, z) - y * z).sum(), 20)
        rest[1] += len(test)
        train = part.train(shared)
        if number == EPOCHS or not train:
            continue
        model, state = copy.deepcopy((base, known))
        order = np.random.default_rng([seed, number, part.number]).permutation(train)
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            _step(model, [part.texts[i] for i in own], part.toxic[own], state)
        changed = np.flatnonzero(state["seen"] != known["seen"])
        out[changed, :DIM] += _exact(model.embedding[changed].astype(np.float64) - base.embedding[changed], CHANGE_BITS)
        out[changed, DIM] += _exact(state["seen"][changed].astype(np.float64) - known["seen"][changed])
        out[changed, DIM + 1] += 1
        dense = np.concatenate([x.ravel() for x in _dense(model, state)]).astype(np.float64)
        rest[2 : 4 + len(dense)] += np.concatenate([[1, state["t"]], _exact(dense)])
    return out


def _average(model: Classifier, state: dict, found: np.ndarray) -> None:
    """Make the model and the optimiser's state the averages of a round's copies."""
    rest = found[BUCKETS + 1 :].reshape(-1)
    trained, at = rest[2], 4
    state["t"] = round(rest[3] / trained)
    for x in _dense(model, state):
        x[...] = (rest[at : at + x.size] / trained).reshape(x.shape)
        at += x.size
    own = np.flatnonzero(found[: BUCKETS + 1, DIM + 1])
    mean = found[own, : DIM + 1] / found[own, DIM + 1 :]
    model.embedding[own] += mean[:, :DIM].astype(np.float32)
    state["seen"][own] += mean[:, DIM].astype(np.float32)


def _place(sent: tuple[Classifier, bool], parts: Iterator[Part]) -> np.ndarray:
    """Checks and toxic ones by place of the logit, for each guessed language."""
    model, shared = sent
    out = np.zeros((2 * PLACES * MOST + 1, 2 * len(model.langs) + 2))
    for part in parts:
        test = part.test(shared)
        texts = [part.texts[i] for i in test]
        at = np.rint(PLACES * np.arcsinh(model.logits(texts))).astype(np.int64) + PLACES * MOST
        guess = model.languages(texts)
        np.add.at(out, (at, 2 * guess), 1)
        np.add.at(out, (at, 2 * guess + 1), part.toxic[test])
    return out


def _cut(counts: np.ndarray) -> float:
    """The best threshold for counts of rows and toxic rows by place."""
    at = np.flatnonzero(counts[:, 0])
    return float(np.sinh(best_threshold(at / PLACES - MOST, counts[at, 1], counts[at, 0])))


def fit_parts(sums: Sums, langs: list[str], seed: int = 0) -> Classifier:
    """The classifier of all parts, with thresholds for these languages where the checks have enough examples."""
    model = Classifier(seed)
    counts = sums(_count, None, (BUCKETS + 2, 4))
    # By use and label, with words and in all.
    usable = np.stack([counts[BUCKETS, [0, 2]] - counts[BUCKETS, [1, 3]], counts[BUCKETS, [1, 3]]])
    rows, toxic = counts[BUCKETS:, [0, 2]].sum(), counts[BUCKETS:, [1, 3]].sum()
    if not 0 < toxic < rows:
        model.constant = float(toxic > 0)
        return model
    if not usable.sum(axis=1).all():
        model.constant = float(toxic / rows >= 0.5)
        return model
    shared = not usable.all()
    count, among = (counts[:, :2] + counts[:, 2:] if shared else counts[:, :2]).T
    share = among[BUCKETS] / count[BUCKETS]
    count, among = count[: BUCKETS + 1].copy(), among[: BUCKETS + 1].copy()
    count[BUCKETS] = among[BUCKETS] = 0
    rng = np.random.default_rng(seed)
    model.embedding[:, 0] = _odds(count, among, share)
    known = np.flatnonzero(count)
    model.embedding[known, 1:] = rng.normal(0, 0.05, (len(known), DIM - 1))
    model.bias[0] = np.log(share / (1 - share))
    best, least, waited, state = model, np.inf, 0, {"t": 0, "seen": np.zeros(BUCKETS + 1, dtype=np.float32)}
    _dense(model, state)
    for number in range(EPOCHS + 1):
        found = sums(_round, (model, state, shared, seed, number), _round_shape(model))
        loss = found[BUCKETS + 1, 0] / found[BUCKETS + 1, 1]
        if loss < least - 1e-4:
            least, waited, best = loss, 0, copy.deepcopy(model)
        elif (waited := waited + 1) >= PATIENCE:
            break
        if number < EPOCHS:
            _average(model, state, found)
    best.langs = langs
    words = sums(_count_languages, langs, (_LANG_BUCKETS, len(langs) + 1)) + 0.5
    if (words[:, -1] == 0.5).all():
        words = words[:, :-1]
    best.lang_table = np.log(words / words.sum(axis=0)).astype(np.float32)
    places = sums(_place, (best, shared), (2 * PLACES * MOST + 1, 2 * len(langs) + 2))
    best.thresholds = np.full(len(langs) + 1, _cut(places.reshape(len(places), -1, 2).sum(axis=1)))
    for k in range(len(langs)):
        own = places[:, 2 * k : 2 * k + 2]
        n, hits = own.sum(axis=0)
        if min(hits, n - hits) >= EXAMPLES:
            best.thresholds[k] = _cut(own)
    return best


def fit(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], seed: int = 0) -> Classifier:
    """Train on the word buckets of one part."""
    checks = mix(np.arange(len(texts), dtype=U64)) % U64(5) == 0
    part = Part(0, texts, np.asarray(toxic, dtype=np.float64), checks, langs)
    seen = Counter(x for x in langs if x is not None)
    hits = Counter(x for x, y in zip(langs, toxic, strict=True) if y)
    enough = sorted(x for x, n in seen.items() if min(hits[x], n - hits[x]) >= EXAMPLES)
    return fit_parts(lambda work, sent, _: work(sent, iter([part])), enough, seed)


class Examples(NamedTuple):
    """(doc_id, key, words, n, lang) of rows that may be labelled, words pressed, and (doc_id, key, n, lang, toxic) of those that are."""

    texts: DataFrame
    labelled: DataFrame


def examples(docs: DataFrame, labels: DataFrame) -> Examples:
    """All labelled rows.  Only ids and numbers move to meet the labels; the words move once, in deal()."""
    judged = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    judged = materialise(judged, "judged")
    # Few rows that have no label are read.
    members = IdFilter(judged.select("doc_id"))
    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64(F.lit(13), "doc_id", "text").alias("key"), "text", "lang", members.place("doc_id").alias("place"))
    schema = T.StructType([keyed.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("lang", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                few = batch.slice(a, 500)
                few = few.filter(pa.array(members.hits(few.column(4).to_numpy())))
                found = [word_buckets(t.as_py()) for t in few.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), few.column(1), pa.array([press_words(x) for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64()), few.column(3)],
                    names=schema.names,
                )

    texts = materialise(keyed.mapInArrow(read, schema), "texts")
    labelled = materialise(texts.select("doc_id", "key", "n", "lang").join(judged, "doc_id"), "examples")
    discard(judged)
    return Examples(texts, labelled)


def deal(rows: Examples) -> DataFrame:
    """The labelled rows in parts of about PART_WORDS words, a part a row."""
    words = rows.labelled.agg(F.sum("n")).head()[0] or 0
    parts = max(1, -(-words // PART_WORDS))
    part = F.pmod("key", F.lit(parts)).cast("int").alias("part")
    check = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(5)) == 0
    texts = rows.texts.select(part, "key", "doc_id", F.lit(False).alias("label"), "lang", "words", "n", F.lit(None).cast("int").alias("toxic"), check.alias("check"))
    none = [F.lit(None).cast(texts.schema[x].dataType).alias(x) for x in ("lang", "words", "n")]
    labels = rows.labelled.select(part, "key", "doc_id", F.lit(True).alias("label"), *none, "toxic", check.alias("check"))
    # Each text comes behind its label; one without belongs to no labelled row.
    placed = texts.unionByName(labels).repartition(parts, "part").sortWithinPartitions("part", "key", "doc_id", F.desc("label"), "lang")
    schema = "part int, words binary, n array<long>, toxic array<int>, checks array<boolean>, langs array<string>"

    def packed(part: int, own: list[tuple]) -> pa.RecordBatch:
        langs, words, n, toxic, checks = zip(*own, strict=True)
        body = press_words(np.concatenate([unpress_words(x, k) for x, k in zip(words, n, strict=True)]))
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.string())
        lists = [pa.array([list(x)], pa.list_(kind)) for x, kind in zip((n, toxic, checks, langs), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([body], pa.binary()), *lists], names=["part", "words", "n", "toxic", "checks", "langs"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, labelled, value, own = None, None, None, []
        for few in (batch.slice(a, 500) for batch in batches for a in range(0, batch.num_rows, 500)):
            for at, key, doc_id, label, lang, words, n, toxic, check in zip(*(c.to_pylist() for c in few.columns), strict=True):
                if at != part and own:
                    yield packed(part, own)
                    own = []
                part = at
                if label:
                    labelled, value = (at, key, doc_id), toxic
                elif labelled == (at, key, doc_id):
                    own.append((lang, words, n, value, check))
                    labelled = None  # a repeated row teaches once
        if own:
            yield packed(part, own)

    return materialise(placed.mapInArrow(pack, schema), "parts")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        for k in range(batch.num_rows):
            number, words, n, toxic, checks, langs = (batch.column(c)[k] for c in range(6))
            ends = np.cumsum(n.values.to_numpy())
            texts = np.split(unpress_words(words.as_buffer(), int(ends[-1])), ends[:-1])
            yield Part(number.as_py(), texts, toxic.values.to_numpy().astype(np.float64), checks.values.to_numpy(zero_copy_only=False), langs.as_py())


def _sliced(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that aren't zero, pressed, a slice of places a row."""
    for k in range(-(-len(found) // SLICE)):
        own = found[k * SLICE : (k + 1) * SLICE]
        at = np.flatnonzero(own.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([press_rows(at, own[at])], pa.list_(pa.binary()))], names=["slice", "n", "rows"])


def _add(out: np.ndarray, batch: pa.RecordBatch | pa.Table) -> None:
    for k, n, bodies in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
        at, rows = unpress_rows(bodies, n, out.shape[1])
        out[k * SLICE + at] += rows


def sums_of(parts: DataFrame) -> Sums:
    """Sums over a table of deal(): tasks send the rows that aren't zero by slices of places, and a slice is added up in one task."""
    spark = parts.sparkSession
    schema = "slice int, n int, rows array<binary>"

    def sums(work: Callable[[Any, Iterator[Part]], np.ndarray], sent: Any, shape: tuple[int, int]) -> np.ndarray:
        held = spark.sparkContext.broadcast(sent)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _sliced(work(held.value, _unpacked(batches)))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                _add(out, batch)
            yield from _sliced(out)

        with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}):  # a part or two at a time
            added = parts.mapInArrow(each, schema).repartition("slice").mapInArrow(add, schema).toArrow()
        held.destroy()
        out = np.zeros(shape)
        _add(out, added)
        return out

    return sums


def train(docs: DataFrame, labels: DataFrame, *, seed: int = 0) -> Classifier:
    rows = examples(docs, labels)
    langs = rows.labelled.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows"))
    enough = langs.where((F.col("toxic") >= EXAMPLES) & (F.col("rows") - F.col("toxic") >= EXAMPLES)).collect()
    parts = deal(rows)
    for x in rows:
        discard(x)
    model = fit_parts(sums_of(parts), sorted(r.lang for r in enough), seed)
    discard(parts)
    return model


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                few = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(sent.value.scores([word_buckets(t.as_py()) for t in few.column(1)]))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
