"""Exact percentiles against numpy, by buffer and by narrowing ranges."""

import numpy as np
import pytest

from tesseral.operators import quantiles
from tesseral.operators.quantiles import percentiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("in_buffer", [0, quantiles.IN_BUFFER])
@pytest.mark.parametrize("broadcast_rows", [0, quantiles.BROADCAST_ROWS])
def test_percentiles_of_awkward_groups(spark, monkeypatch, in_buffer, broadcast_rows):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(5)
    groups = {
        "ties": [1.0] * 700 + [2.0, 3.0],
        "one": [4.5],
        "two": [0.0, 1.0],
        "wide": np.exp(rng.normal(0, 40, 400)).tolist() + [1e308, -1e308, 0.0],
        "spread": rng.normal(size=999).tolist(),
        "tiny": [5e-324, 1e-323, 0.0],
        None: [float(x) for x in range(10)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rows += [("ties", None), ("ties", float("nan")), ("none", None), ("none", float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r.q for r in percentiles(df, ["k"], "x", SHARES, in_buffer).collect()}
    assert got.pop("none") is None and set(got) == set(groups)
    for k, vs in groups.items():
        # Not numpy's interpolation, whose difference of the two overflows here.
        v, want = sorted(vs), []
        for p in SHARES:
            at = p * (len(v) - 1)
            low, part = int(at), at - int(at)
            want.append(v[low] if part == 0 else (1 - part) * v[low] + part * v[low + 1])
        assert got[k] == pytest.approx(want, rel=1e-12, abs=0), k


@pytest.mark.parametrize("in_buffer", [0, quantiles.IN_BUFFER])
def test_percentiles_without_keys(spark, in_buffer):
    df = spark.createDataFrame([(float(x), "a") for x in range(101)], "x double, v string")
    assert [tuple(r) for r in percentiles(df, [], "x", [0.5, 0.905], in_buffer).collect()] == [([50.0, 90.5],)]
    assert [r.q for r in percentiles(df.limit(0), [], "x", [0.5], in_buffer).collect()] == [None]
    assert percentiles(df.limit(0), ["v"], "x", [0.5], in_buffer).collect() == []
