"""Personal data: patterns propose spans, checksums confirm them, and words
nearby move the score.

`find_pii` returns one row per document with an array of spans
(kind, start, end, score, base); offsets count code points, ends are exclusive.
The base kinds are email, ip, card and phone; their candidates are the leftmost
non-overlapping matches of each kind, a match that fails its validator is
dropped without a retry, and every confirmed one is kept whatever its score.
The method adds kinds of its own (iban: mod-97; national: a telephone number
without country code; ssn), and these need a score of `threshold` or more,
which the last two only reach with a whole context word within `window` code
points before or after.

Null text counts as empty, empty text has no spans, repeated rows are judged
each for themselves, an empty table gives an empty one, and further columns of
the input are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "national", "ssn")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Characters of an IBAN by country code.
_IBAN_LENGTH = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
_NATIONAL = re.compile(r"(?<![0-9+(.-])\(?0?[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-][0-9]{3,5}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_CONTEXT = {
    "national": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|telefon|anruf|teléfono|téléphone)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|cuenta|compte)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|kreditkarte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|telefon|teléfono|téléphone)\b", re.I),
    "email": re.compile(r"\b(?:e-?mail|mail|contact)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server)\b", re.I),
}
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national": 0.3, "ssn": 0.3}
#: What a context word within the window adds.
_BOOST = 0.35

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("base", T.BooleanType()),
    ]
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k & 1:
            v += v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed IBANs from left to right.  A candidate runs into words behind
    the number, so its shorter ends are tried too: that of its country's length,
    or all, longest first, where the country is not known."""
    m = _IBAN.search(text)
    while m:
        start, end = m.span()
        length = _IBAN_LENGTH.get(text[start : start + 2])
        while end > start:
            number = text[start:end].replace(" ", "")
            if length in (None, len(number)) and _IBAN.fullmatch(text, start, end) and mod97(number):
                yield start, end
                break
            end = text.rfind(" ", start, end)
        m = _IBAN.search(text, max(end, start + 1))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, '@' and a dotted domain, found from
    the '@' so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", *m.span()


def _near(kind: str, text: str, a: int, b: int, window: int) -> bool:
    """Whether a context word lies whole within `window` code points before or after."""
    for start, end in ((max(0, a - window), a), (b, min(len(text), b + window))):
        for m in _CONTEXT[kind].finditer(text, start, end):
            # The pattern sees what is before `start`, but not what is behind `end`.
            if m.end() < end or end == len(text) or not (text[end].isalnum() or text[end] == "_"):
                return True
    return False


def _free(spans: list[tuple[int, int]]):
    """A test whether a span overlaps none of the given ones."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    ends = [b for _, b in joined]

    def free(a: int, b: int) -> bool:
        k = bisect_left(ends, a + 1)
        return k == len(joined) or b <= joined[k][0]

    return free


def spans_of(text: str | None, threshold: float = 0.6, window: int = 40) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text by start, then kind as listed in KINDS."""
    if not text:
        return []
    found = [(k, a, b, True) for k, a, b in base_spans(text)]
    if _DIGIT.search(text):
        free = _free([(a, b) for _, a, b, _ in found])
        extra = [("iban", *span) for span in _ibans(text)]
        extra += [("national", *m.span()) for m in _NATIONAL.finditer(text)]
        extra += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        found += [(k, a, b, False) for k, a, b in extra if free(a, b)]
    scored = [(k, a, b, min(1.0, _PRIOR[k] + _BOOST * _near(k, text, a, b, window)), base) for k, a, b, base in found]
    kept = [x for x in scored if x[4] or x[3] >= threshold]
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))


_SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])
)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.6, window: int = 40) -> DataFrame:
    """(id, spans) for every row; see the module's text."""
    kind = docs.schema[id_col].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in spans_of(t.as_py(), threshold, window)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=_SPANS_ARROW)], names=["id", "spans"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("spans", T.ArrayType(SPAN))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", *, threshold: float = 0.6, window: int = 40) -> DataFrame:
    """The same rows and columns with every span replaced by [KIND].  Of
    overlapping spans the union is replaced, under the first one's kind.
    Null and empty texts stay as they are."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def cut(text: str | None) -> str | None:
        found = spans_of(text, threshold, window)
        if not found:
            return text
        out, done = [], 0
        for kind, a, b, _, _ in found:
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([cut(t.as_py()) for t in batch.column(at)], type=batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(scan, schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """The counts and digests of a find_pii() table."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))
