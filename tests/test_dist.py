"""Distribution functions against sums of 60 digits."""

import math
from decimal import Decimal as D, getcontext

import pytest
from pyspark.sql import functions as F

from tesseral.functions import dist

getcontext().prec = 60


def both_tails(family, k, mu, alpha):
    """(P(Y <= k), P(Y > k)), the second by summing on until nothing is added."""
    m, r = D(mu), D(1) / D(alpha or 1)
    if family == "nb":
        q = m / (r + m)
        term, ratio = (D(1) - q) ** r, lambda j: (j + r) / (j + 1) * q
    else:
        term, ratio = (-m).exp(), lambda j: m / (j + 1)
    low = term
    for j in range(k):
        term *= ratio(D(j))
        low += term
    return float(low), float(D(1) - low)


CASES = [
    (family, k, mu, alpha)
    for family, alphas in (("poisson", [None]), ("nb", [1e-9, 1e-3, 0.05, 0.5, 1.0, 7.0, 100.0]))
    for alpha in alphas
    for k, mus in {0: [1e-8, 0.3, 30.0], 7: [0.5, 7.0, 90.0], 64: [40.0, 65.0, 90.0], 65: [1.0, 30.0, 60.0, 66.0, 67.0, 150.0, 500.0], 300: [200.0, 301.0, 350.0, 3000.0], 3000: [2800.0, 3001.0, 3100.0, 9.0e4]}.items()
    for mu in mus
]


def test_distribution_functions(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, family string, k long, mu double, alpha double").repartition(4)
    args = [F.col(c) for c in ("family", "k", "mu", "alpha")]
    rows = sorted(df.select("i", dist.cdf(*args).alias("low"), dist.survival(*args).alias("high")).collect())
    assert len(rows) == len(CASES)
    for row, case in zip(rows, CASES, strict=True):
        low, high = both_tails(*case)
        assert row.low == pytest.approx(low, rel=1e-12 if case[1] > dist.SUM_UP_TO else 1e-11, abs=1e-300), case
        assert row.high == pytest.approx(high, rel=1e-12, abs=1e-300 if case[1] > dist.SUM_UP_TO and high > 1e-40 else 1e-12), case


def test_negative_counts_and_nulls(spark):
    one = spark.range(1)
    args = lambda k: (F.lit("nb"), F.lit(k).cast("long"), F.lit(2.0), F.lit(0.5))
    row = one.select(dist.cdf(*args(-1)).alias("a"), dist.survival(*args(-1)).alias("b"), dist.cdf(*args(None)).alias("c")).head()
    assert tuple(row) == (0.0, 1.0, None)


@pytest.mark.parametrize("r", [1e-9, 1e-3, 0.5, 1.0, 9.5, 250.0, 1e6, 1e9])
def test_log_rising(spark, r):
    ys = [0, 1, 2, 9, 10, 11, 100, 2500]
    got = [x.v for x in spark.createDataFrame([(y,) for y in ys], "y long").coalesce(1).select(dist.log_rising(F.lit(r), F.col("y")).alias("v")).collect()]
    want = [float(sum(((D(r) + j).ln() for j in range(y)), D(0))) for y in ys]
    assert got == pytest.approx(want, rel=1e-13, abs=1e-12)
    assert dist.STIRLING[0] == pytest.approx(1 / 12) and math.isclose(want[1], math.log(r))


def test_large_counts_have_the_whole_distribution_function(spark):
    # Beyond the 100 terms at which the queries' SQL ends.
    rows = spark.createDataFrame([("poisson", 955, 900.0, None), ("nb", 955, 900.0, 0.5), ("poisson", 130, 110.0, None)], "family string, y long, mu double, alpha double")
    got = [r.cdf for r in rows.withColumn("cdf", dist.cdf(F.col("family"), F.col("y"), F.col("mu"), F.col("alpha"))).collect()]
    want = []
    for family, y, mu, alpha in [tuple(r) for r in rows.collect()]:
        r = 1 / alpha if alpha else None
        log = [
            math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + r * math.log(r / (r + mu)) + k * math.log(mu / (r + mu)) if family == "nb" else k * math.log(mu) - mu - math.lgamma(k + 1)
            for k in range(y + 1)
        ]
        want.append(math.fsum(map(math.exp, log)))
    assert got == pytest.approx(want, rel=1e-10)
