"""Canonical events (event_id, time, latitude, longitude, mag) from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _placed(rows: DataFrame, cell: Column, per_row: int, row_id: str, time: str, mag: Column) -> DataFrame:
    """Cell k sits in row k div per_row, column k mod per_row; ids jitter events inside it."""
    k, i = F.col("k"), F.col(row_id)
    return rows.withColumn("k", cell.cast("long")).select(
        i.alias("event_id"),
        F.col(time).alias("time"),
        (F.lit(38.0) + 3 * F.floor(k / per_row) + 0.9 * ((i % 100) + 0.5) / 100).alias("latitude"),
        (F.lit(65.0) + 3 * (k % per_row) + 0.9 * ((i % 89) + 0.5) / 89).alias("longitude"),
        mag.alias("mag"),
    )


def balanced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` dealt evenly over 21 cells; near Poisson by the hour."""
    return _placed(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id") % 21, 7, "event_id", "ts", 3 + F.col("value") / 100)


def bursty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` in bursts of growing length over 21 cells; overdispersed."""
    k = F.floor((F.sqrt(8 * (F.col("event_id") % 231) + 1) - 1) / 2)
    return _placed(spark.read.parquet(f"{sf_dir}/events.parquet"), k, 7, "event_id", "ts", 3 + F.col("value") / 100)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` in the cell of their customer's nation; several years of weeks."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return _placed(orders.join(nations, "o_custkey"), F.col("c_nationkey"), 5, "o_orderkey", "o_orderdate", 3 + F.col("o_totalprice") / 125000)
