"""WARC archives: write, read back, and merge their indexes.

`write_archives` writes one record per capture as runs: files of WARC 1.1
records, each record a gzip member of its own, each run sorted by (URL key,
timestamp, id).  A payload's first capture (the least id) is a response, every
other one of at least `min_bytes` a revisit of it without a body.
`read_archives` streams the records back, recomputes the payload digests, and
yields one index row per record, whose offset and length are those of its gzip
member, so that `read_record` gets a record without its run.  `merge_index`
merges the runs' sorted indexes by a loser tree into globally ordered capture
histories: the key space is cut into ranges of bounded size, and each range
merges its segment of every run.  `captures` does all three.

The URL key is a function of the target line as it is written and read back, in
one implementation, so that a run is in the order that its reader sees.  A run
ends at `run_records` records or `run_bytes` bytes; a reader holds one record.
The manifest that write_archives returns names the runs that count: a task that
is run again writes files of other names.

Null html is an empty payload.  A null URL has an empty URL key and no target
line; carriage returns and line feeds in a URL are percent-encoded in the
target line.  Rows that repeat an id and its payload are all of one type, and
records of their own; a null id is never the first of its payload unless all
are null, and then all are responses.  An empty table gives an empty one.
Further columns of the input are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.shared import IdFilter, materialise, new_path, utf8

#: Copies of each repeated payload's row in the join that finds its first capture.
SALTS = 64
#: Repeated payloads that are sent to all tasks at most (some 100 bytes each).
SENT_ROWS = 200_000
EPOCH = 1_704_067_200
#: Records and bytes of one run, and index rows of one merged range.
RUN_RECORDS, RUN_BYTES, RANGE_ROWS = 50_000, 64 << 20, 200_000
LEVEL, CHUNK = 4, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed, then the rest of the URL."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.when(url.isNull(), F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(rest)))
    )


def target_line(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as tasks reach it, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


_RUNS = "run string, records long, bytes long"


def first_captures(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(sha, first, first_at, first_target) of the payloads of two captures or
    more; digests alone meet, and combine before they do."""
    capture = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "at", "target"))
    found = rows.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(capture).alias("f")).where("n > 1 AND f IS NOT NULL")
    return found.select("sha", F.col("f.page_id").alias("first"), F.col("f.at").alias("first_at"), F.col("f.target").alias("first_target"))


def with_first(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows with the first capture of their payload.  Few repeated payloads
    go to the rows; of many, only the rows that may have one move, and each
    payload's captures do so in SALTS parts, so that one with a third of all
    captures is written by many tasks."""
    if repeated.count() <= SENT_ROWS:
        return rows.join(F.broadcast(repeated), "sha", "left")
    members = IdFilter(repeated.select("sha"))
    salted = members.split(rows, "sha", True).withColumn("salt", F.pmod(F.xxhash64("page_id", "target"), F.lit(SALTS)))
    copies = repeated.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    moved = salted.join(copies, ["sha", "salt"], "left").drop("salt")
    return members.split(rows, "sha", False).unionByName(moved, allowMissingColumns=True)


def write_archives(
    pages: DataFrame, path: str, *, min_bytes: int = 0, at: Column | None = None, run_records: int = RUN_RECORDS, run_bytes: int = RUN_BYTES
) -> DataFrame:
    """Write (page_id, url, html) as runs under `path`; returns their manifest
    (run, records, bytes).

    at: the capture's time in whole seconds; by default a fixed function of
    page_id, as `pages` has none.
    """
    html = F.coalesce("html", F.lit(""))
    seconds = at if at is not None else F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))
    date = F.date_format(F.timestamp_seconds(seconds.cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), date.alias("at"), target_line(F.col("url")).alias("target"),
        F.sha1(utf8(html)).alias("sha"), F.octet_length(html).cast("long").alias("bytes"), html.alias("html"),
    )
    repeated = materialise(first_captures(rows.drop("html"), min_bytes), "repeated")
    typed = with_first(rows, repeated).withColumn("revisit", F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull()))
    ready = typed.select(
        "page_id", "at", "target", "sha", "bytes", "revisit", "first", "first_at", "first_target",
        F.when(F.col("revisit"), F.lit(None)).otherwise(F.col("html")).alias("html"), url_key(F.col("target")).alias("key"),
    )
    runs = ready.sortWithinPartitions("key", "at", "page_id").mapInArrow(_writer(path, run_records, run_bytes), _RUNS)
    return materialise(runs, "runs")


def _record(row: dict, name: str) -> bytes:
    """One record; `name` is its id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    payload = b"" if row["revisit"] else row["html"].encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {row['at']}"]
    if row["target"] is not None:
        lines.append(f"WARC-Target-URI: {row['target']}")
    if row["page_id"] is not None:
        lines.append(f"Page-ID: {row['page_id']}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['sha'])).decode()}")
    if row["revisit"]:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {row['first_at']}", f"Refers-To-Page-ID: {row['first']}"]
        if row["first_target"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {row['first_target']}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + http + payload + b"\r\n\r\n"


def _writer(path: str, run_records: int, run_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(path)
        store.create_dir(top, recursive=True)
        context = TaskContext.get()
        stem, number, done, out = f"run-{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, None
        made = []

        def close() -> None:
            out.close()
            made.append(done)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    if out is None or done["records"] >= run_records or done["bytes"] >= run_bytes:
                        if out is not None:
                            close()
                        file = f"{stem}-{number:05d}.warc.gz"
                        out, done = store.open_output_stream(f"{top}/{file}", compression=None), {"run": f"{path}/{file}", "records": 0, "bytes": 0}
                        number += 1
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(_record(row, f"<urn:capture:{file}:{done['records']}>")) + packer.flush()
                    out.write(member)
                    done["records"] += 1
                    done["bytes"] += len(member)
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("run", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


_READ = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("uri", T.StringType()),
        T.StructField("at", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)


def parse_record(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """(headers by lower-cased name, block) of one record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("no WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = data[end + 4 : -4]
    if len(block) != int(head[b"content-length"]) or data[-4:] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    return head, block


def members(stream) -> Iterator[tuple[bytes, int, int]]:
    """(content, offset, length) of each gzip member of a stream of bytes."""
    rest, offset = b"", 0
    while True:
        z, out, length = zlib.decompressobj(31), [], 0
        while not z.eof:
            rest = rest or stream.read(CHUNK)
            if not rest:
                if length:
                    raise ValueError("the archive is cut off")
                return
            out.append(z.decompress(rest))
            length += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield b"".join(out), offset, length
        offset += length


def read_record(run: str, offset: int, length: int) -> tuple[dict[bytes, bytes], bytes]:
    """The record at the place that its index row names."""
    store, file = open_store(run)
    with store.open_input_file(file) as f:
        return parse_record(zlib.decompress(f.read_at(length, offset), 31))


def _indexed(run: str) -> Iterator[dict]:
    store, file = open_store(run)
    number = lambda v: None if v is None else int(v)
    with store.open_input_stream(file, compression=None) as stream:
        for seq, (data, offset, length) in enumerate(members(stream)):
            head, block = parse_record(data)
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
            kind = head[b"warc-type"].decode()
            digest = head[b"warc-payload-digest"].decode().removeprefix("sha1:")
            if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"{run}: the payload at byte {offset} has another digest")
            uri = head.get(b"warc-target-uri")
            yield {
                "run": run, "seq": seq, "uri": None if uri is None else uri.decode(), "at": head[b"warc-date"].decode(),
                "page_id": number(head.get(b"page-id")), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
                "refers_to": number(head.get(b"refers-to-page-id")), "offset": offset, "length": length,
            }


def read_archives(runs: DataFrame) -> DataFrame:
    """One index row per record of the runs that a manifest names, with the URL
    key; each run is streamed by one task, and its digests are recomputed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(_READ)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0).to_pylist():
                held = []
                for row in _indexed(run):
                    held.append(row)
                    if len(held) == 2_000:
                        yield pa.RecordBatch.from_pylist(held, schema=shape)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=shape)

    n, amount = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).head()
    tasks = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(amount) // RUN_BYTES)
    return runs.select("run").repartition(max(1, min(n, tasks))).mapInArrow(parse, _READ).withColumn("key", url_key(F.col("uri")))


class LoserTree:
    """Merges k sorted sequences; each step replays one path of comparisons."""

    def __init__(self, sources: list[Iterable[tuple]]):
        self.sources = [iter(s) for s in sources]
        self.k = max(1, len(sources))
        self.heads: list[tuple | None] = [next(s, None) for s in self.sources] or [None]
        self.losers = [-1] * self.k
        self.winner = 0
        for leaf in range(self.k):
            self._enter(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _enter(self, leaf: int) -> None:
        """Build: a contender waits at the first empty node above it."""
        node, best = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = best
                return
            if self._less(self.losers[node], best):
                self.losers[node], best = best, self.losers[node]
            node //= 2
        self.winner = best

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            best = self.winner
            yield self.heads[best]
            self.heads[best] = next(self.sources[best], None)
            node = (best + self.k) // 2
            while node > 0:
                if self._less(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.winner = best


def _segment(rows: pa.Table, name: str, first: int, last: int, step: int = 1_000) -> Iterator[tuple]:
    """(key, at, id known, id, run, seq, row) of one run's segment, in order, a few rows at a time."""
    before = None
    for a in range(first, last, step):
        part = rows.slice(a, min(step, last - a))
        columns = (part.column(c).to_pylist() for c in ("key", "at", "page_id", "seq"))
        for k, (key, at, page, seq) in enumerate(zip(*columns, strict=True)):
            now = (key, at, page is not None, page or 0)
            if before is not None and now < before:
                raise ValueError(f"the run {name} isn't sorted")
            before = now
            yield (*now, name, seq, a + k)


def merge_index(index: DataFrame, ranges: int) -> DataFrame:
    """Order all index rows by (key, at, page_id): the rows of read_archives()
    with their range and their position in it.  A range takes a contiguous part
    of the order, ids included, so that a URL with very many captures spreads
    over several.  Within a range every run's segment is already sorted: the
    segments stay Arrow rows, the tree holds one row of each, and the merged
    order leaves in small batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*index.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("position", T.LongType())])
    shape = to_arrow_schema(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        run = rows.column("run").to_pylist()
        starts = [0, *(k for k in range(1, len(run)) if run[k] != run[k - 1]), len(run)]
        tree = LoserTree([_segment(rows, run[a], a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)])
        part, position, order = TaskContext.get().partitionId(), 0, []

        def ordered() -> Iterator[pa.RecordBatch]:
            taken = rows.take(pa.array(order, pa.int64()))
            place = [pa.array([part] * len(order), pa.int32()), pa.array(range(position, position + len(order)), pa.int64())]
            yield from pa.Table.from_arrays([*taken.columns, *place], schema=shape).to_batches()

        for entry in tree:
            order.append(entry[-1])
            if len(order) == 10_000:
                yield from ordered()
                position += len(order)
                order = []
        if order:
            yield from ordered()

    cut = index.repartitionByRange(ranges, "key", "at", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return cut.mapInArrow(merge, schema)


def captures(pages: DataFrame, *, min_bytes: int = 0, run_records: int = RUN_RECORDS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, and
    return the merged index, in ranges of about RANGE_ROWS rows or fewer."""
    spark = pages.sparkSession
    runs = write_archives(pages, new_path(spark, "warc"), min_bytes=min_bytes, run_records=run_records, run_bytes=run_bytes)
    index = materialise(read_archives(runs), "cdx")
    return merge_index(index, max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.count() // RANGE_ROWS + 1))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back."""
    return captures(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = " || ".join(
    f"substr('{_ALPHABET}', (('0x' || substr(sha, {5 * g + 1}, 5))::BIGINT >> {s}) % 32 + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)
OP10_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM payloads
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM firsts
"""
