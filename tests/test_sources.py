"""Scans, sinks and the stream of bucket counts."""

from pyspark.sql import functions as F

from tesseral.operators import ingest, panel
from tesseral.sources import adapters, catalogue
from tesseral.streaming.buckets import stream_counts


def test_csv_round_trip_and_upsert(spark, tmp_path):
    raw = spark.createDataFrame([("2020-01-06 00:00:00", "40", "70", "bad", "3.3", "x, y")], catalogue.RAW_SCHEMA)
    catalogue.write_table(raw, f"{tmp_path}/raw.csv", "csv")
    row = ingest.clean_catalogue(catalogue.read_raw(spark, f"{tmp_path}/raw.csv")).head()
    assert (row.latitude, row.depth, row.place) == (40.0, None, "x, y")
    schema = "model string, mae double"
    first = catalogue.upsert_table(spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema), f"{tmp_path}/t", "model", schema)
    catalogue.write_table(first, f"{tmp_path}/t")
    second = catalogue.upsert_table(spark.createDataFrame([("b", 3.0)], schema), f"{tmp_path}/t", "model", schema)
    assert sorted(map(tuple, second.collect())) == [("a", 1.0), ("b", 3.0)]


def test_request_covers_the_box():
    p = catalogue.request_params()
    assert p["minlatitude"] == "38.0" and p["maxlongitude"] == "85.0" and p["format"] == "csv"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = adapters.order_events(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = stream_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.cell_id, str(r.week), r.y) for r in df.collect())
    batch = panel.aggregate_cells(panel.bin_events(adapters.order_events(spark, sf_dir)))
    assert key(spark.table("counts")) == key(batch)
