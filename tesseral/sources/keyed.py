"""Stored tables whose rows are replaced by key.

A table is a folder: Parquet files by bucket of the key's hash, and numbered
versions, each a small file that names the folder of every bucket.  An upsert
writes anew only the buckets that its keys fall in, beside the old ones, and
then adds a version under its final name; a reader takes the greatest number,
so it sees all of an upsert or nothing of it, and tables that are being read
stay as they were.  One writer at a time: a version that another one has added
meanwhile is an error where the file system refuses to rename onto a file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.sources.staging import stage

BUCKETS = 16


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _version(spark: SparkSession, folder: str) -> dict | None:
    files, at = _path(spark, f"{folder}/versions/v*.json")
    found = [s.getPath().toString() for s in files.globStatus(at) or []]
    return json.loads(spark.read.text(max(found), wholetext=True).head()[0]) if found else None


def _publish(spark: SparkSession, folder: str, version: dict) -> None:
    name = f"{folder}/versions/v{version['number']:012d}.json"
    files, draft = _path(spark, f"{folder}/versions/draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    final = _path(spark, name)[1]
    if files.exists(final) or not files.rename(draft, final):
        raise FileExistsError(f"another writer has added {name}")


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")


def read(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The table as of its last version; an empty one of the schema given where nothing is stored."""
    version = _version(spark, folder.rstrip("/"))
    if version is None:
        if schema is None:
            raise FileNotFoundError(folder)
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType.fromJson(version["schema"])).parquet(*version["paths"].values())


def upsert(new: DataFrame, folder: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Replace the stored rows of new's keys by new's rows, and add those of other
    keys; returns the number of the version.  Null keys equal each other; rows of
    new that share a key all stay; a column that one side lacks is null there; no
    rows change nothing but the number.  The first upsert fixes keys and buckets."""
    spark, folder = new.sparkSession, folder.rstrip("/")
    before = _version(spark, folder)
    if before and (before["keys"] != keys):
        raise ValueError(f"the table's keys are {before['keys']}")
    buckets = before["buckets"] if before else buckets
    fresh = stage(new.select("*", _bucket(keys, buckets)))
    touched = sorted(r._bucket for r in fresh.select("_bucket").distinct().collect())
    rows, paths = fresh, dict(before["paths"]) if before else {}
    stored = [paths[str(b)] for b in touched if str(b) in paths]
    schema = new.schema
    if before:
        known = T.StructType.fromJson(before["schema"])
        old = spark.read.schema(known).parquet(*stored) if stored else spark.createDataFrame([], known)
        changed = fresh.select(*(F.col(k).alias(f"_new_{k}") for k in keys)).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        kept = old.join(changed, same, "left_anti").select("*", _bucket(keys, buckets))
        rows = kept.unionByName(fresh, allowMissingColumns=True)
        schema = rows.drop("_bucket").schema
    if touched:
        part = f"{folder}/part-{uuid.uuid4().hex}"
        # Rebalanced, not hashed to a task each: a bucket of a hot key is split.
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(part)
        paths |= {str(b): f"{part}/_bucket={b}" for b in touched}
    elif not paths:
        part = f"{folder}/part-{uuid.uuid4().hex}/_bucket=0"
        new.write.parquet(part)
        paths = {"0": part}
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    number = (before["number"] if before else 0) + 1
    _publish(spark, folder, {"number": number, "keys": keys, "buckets": buckets, "schema": json.loads(nullable.json()), "paths": paths})
    return number


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Delete what the last version doesn't name: for a time when nobody reads an
    older one or writes.  Returns the folders that went."""
    folder = folder.rstrip("/")
    version = _version(spark, folder)
    used = {p.rsplit("/", 1)[-2] for p in version["paths"].values()} if version else set()
    used_buckets = {p.split("/part-", 1)[1] for p in version["paths"].values()} if version else set()
    files, at = _path(spark, f"{folder}/part-*/_bucket=*")
    gone = []
    for status in files.globStatus(at) or []:
        name = status.getPath().toString().split("/part-", 1)[1]
        if name not in used_buckets:
            files.delete(status.getPath(), True)
            gone.append(name)
    files, at = _path(spark, f"{folder}/part-*")
    for status in files.globStatus(at) or []:
        if f"part-{status.getPath().toString().split('/part-', 1)[1]}" not in {u.rsplit("/", 1)[-1] for u in used}:
            files.delete(status.getPath(), True)
    return sorted(gone)
