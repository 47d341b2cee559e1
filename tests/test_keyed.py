"""Stored tables with rows replaced by key, and the driver of all result tables."""

import pytest

from tesseral.sources import catalogue, keyed

SCHEMA = "model string, year int, mae double"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_of_a_table_that_is_being_read(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    assert keyed.read(spark, at, SCHEMA).count() == 0
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, at)
    first = [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), (None, 1, 4.0), (None, 1, 5.0)]
    assert keyed.upsert(spark.createDataFrame(first, SCHEMA), at, ["model", "year"]) == 1
    reader = keyed.read(spark, at)
    assert _rows(reader) == sorted(first, key=str)
    # From the table itself, with keys that are null, repeated and new, and a further column.
    changed = [("a", 2, 20.0, "x"), (None, 1, 40.0, "y"), ("c", 9, 7.0, None), ("c", 9, 7.0, None)]
    assert keyed.upsert(spark.createDataFrame(changed, SCHEMA + ", note string"), at, ["model", "year"]) == 2
    want = sorted([("a", 1, 1.0, None), ("b", 1, 3.0, None), *changed], key=str)
    assert _rows(keyed.read(spark, at)) == want
    # Whoever began before sees the table as it was.
    assert _rows(reader) == sorted(first, key=str)
    assert keyed.upsert(keyed.read(spark, at).where("model = 'b'").selectExpr("model", "year", "mae * 2 AS mae", "note"), at, ["model", "year"]) == 3
    assert ("b", 1, 6.0, None) in _rows(keyed.read(spark, at))
    with pytest.raises(ValueError, match="keys"):
        keyed.upsert(spark.createDataFrame(first, SCHEMA), at, ["model"])


def test_a_writer_that_ends_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    keyed.upsert(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], SCHEMA), at, ["model"])
    publish = keyed._publish

    def crash(*a):
        raise OSError("lost")

    monkeypatch.setattr(keyed, "_publish", crash)
    new = spark.createDataFrame([("a", 1, 9.0)], SCHEMA)
    with pytest.raises(OSError):
        keyed.upsert(new, at, ["model"])
    assert _rows(keyed.read(spark, at)) == [("a", 1, 1.0), ("b", 1, 2.0)]
    monkeypatch.setattr(keyed, "_publish", publish)
    assert keyed.upsert(new, at, ["model"]) == 2
    version = keyed._version(spark, at)
    with pytest.raises(FileExistsError):
        publish(spark, at, version)
    assert _rows(keyed.read(spark, at)) == [("a", 1, 9.0), ("b", 1, 2.0)]
    # The crashed writer's bucket and the one replaced.
    assert len(keyed.clean(spark, at)) == 2 and keyed.clean(spark, at) == []
    assert _rows(keyed.read(spark, at)) == [("a", 1, 9.0), ("b", 1, 2.0)]


def test_empty_upserts(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    keyed.upsert(none, f"{tmp_path}/t", ["model"])
    assert keyed.read(spark, f"{tmp_path}/t").count() == 0
    keyed.upsert(spark.createDataFrame([("a", 1, 1.0)], SCHEMA), f"{tmp_path}/t", ["model"])
    keyed.upsert(none, f"{tmp_path}/t", ["model"])
    assert _rows(keyed.read(spark, f"{tmp_path}/t")) == [("a", 1, 1.0)]
