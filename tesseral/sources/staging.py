"""Tables written once where several parts of a plan read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where
    that is unset and all run in one machine, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back: whatever reads it
    doesn't compute it again, and a lost executor doesn't either."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
