"""Poisson and negative binomial (mean mu, variance mu + alpha mu^2) expressions.

Nothing leaves the JVM, and no expression but the ranked score, which is a sum over
the counts by definition, takes longer for larger counts.  Differences of log-gamma
come from Stirling's series.  The distribution function is a sum of its terms up to
SUM_UP_TO and beyond that the incomplete gamma or beta function as an integral with
a fixed number of nodes, over the side that the mode isn't on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.config import FLOOR

SUM_UP_TO = 64
#: Where exp(h) no longer counts, and how far an end may be.
DEPTH, FAR = 40.0, 45.0
#: Stirling's series, from 1 / x on.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def _nodes(n: int = 64) -> Column:
    """Gauss-Legendre nodes x of [0, 1] with their weights w."""
    x, w = np.polynomial.legendre.leggauss(n)
    return F.expr("array(" + ", ".join(f"named_struct('x', {float(a + 1) / 2:.17e}D, 'w', {float(b) / 2:.17e}D)" for a, b in zip(x, w, strict=True)) + ")")


def _steps(n: Column) -> Column:
    """[0, .., n - 1]; empty for n = 0, as a sequence would count down."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def _stirling(x: Column) -> Column:
    """lgamma(x) - ((x - 1/2) ln x - x + ln(2 pi) / 2), x >= 10."""
    out = F.lit(0.0)
    for c in reversed(STIRLING):
        out = out / (x * x) + F.lit(c)
    return out / x


def _shifted_product(x: Column) -> Column:
    """x (x + 1) .. (x + 9), which takes an argument to where the series holds."""
    return reduce(lambda p, j: p * (x + j), range(1, 10), x)


def log_rising(r: Column, y: Column) -> Column:
    """ln of r (r + 1) .. (r + y - 1), r > 0, y >= 0; no cancellation for large r."""
    low, high = r + 10, r + y + 10
    ratio = reduce(lambda p, j: p * ((r + y + j) / (r + j)), range(10), F.lit(1.0))
    return y * F.log(high) + (low - 0.5) * F.log1p(y / low) - y + _stirling(high) - _stirling(low) - F.log(ratio)


def log_factorial(y: Column) -> Column:
    return log_rising(F.lit(1.0), y)


def poisson_nll(y: Column, mu: Column) -> Column:
    """Without the term in y alone."""
    m = F.greatest(mu, F.lit(FLOOR))
    return m - y * F.log(m)


def poisson_nll_full(y: Column, mu: Column) -> Column:
    return poisson_nll(y, mu) + log_factorial(y)


def nb_nll(y: Column, mu: Column, alpha: Column) -> Column:
    m, a = F.greatest(mu, F.lit(FLOOR)), F.greatest(alpha, F.lit(FLOOR))
    r = F.lit(1.0) / a
    return log_factorial(y) - log_rising(r, y) + r * F.log1p(a * m) - y * F.log(m / (r + m))


def poisson_deviance(y: Column, mu: Column) -> Column:
    """Of one row: 2 (y ln(y / mu) - y + mu)."""
    return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0)) - y + mu)


def poisson_deviance_guarded(y: Column, mu: Column, eps: float = 1e-9) -> Column:
    """The deviance with a small number inside the logarithm."""
    return 2 * (F.when(y > 0, y * F.log(y / mu + F.lit(eps))).otherwise(F.lit(0.0)) - y + mu)


def _terms(family: Column, mu: Column, alpha: Column) -> tuple[Column, object]:
    """ln P(0) and the ratio P(k + 1) / P(k) as a function of k."""
    r = F.lit(1.0) / alpha
    nb = family == "nb"
    log0 = F.when(nb, -r * F.log1p(alpha * mu)).otherwise(-mu)
    ratio = lambda k: F.when(nb, (k + r) / (k + 1) * (alpha * mu / (F.lit(1.0) + alpha * mu))).otherwise(mu / (k + 1))
    return log0, ratio


def _let(values: Column, f: Callable[[Column], Column]) -> Column:
    """f of a struct that is evaluated once a row, as lambdas would evaluate it at each step."""
    return F.get(F.transform(F.array(values), f), F.lit(0))


def _sum_of_terms(family: Column, k: Column, m: Column, a: Column) -> Column:
    """P(Y <= k) term by term, the running term as a logarithm, so that a first
    term too small for a double loses nothing."""
    log0, ratio = _terms(family, m, a)
    start = F.struct(log0.alias("t"), F.exp(log0).alias("s"))
    return F.aggregate(
        _steps(k),
        start,
        lambda x, j: F.struct((x["t"] + F.log(ratio(j))).alias("t"), (x["s"] + F.exp(x["t"] + F.log(ratio(j)))).alias("s")),
        lambda x: F.least(x["s"], F.lit(1.0)),
    )


def _smaller_side(family: Column, k: Column, m: Column, a: Column) -> Column:
    """P(Y <= k) where m > k + 1, otherwise P(Y > k); k > SUM_UP_TO.

    With b = k + 1, r = 1 / a and q = m / (r + m), P(Y <= k) is the incomplete beta
    integral of x^(b - 1) (1 - x)^(r - 1) from q to 1, and for Poisson the gamma
    integral from m on.  In v, the logarithm of the odds x / (1 - x) over those of q, the
    integrand is exp(h), h(v) = b v - (b + r) ln(1 + q (e^v - 1)), or
    h(v) = b v - m (e^v - 1), which is concave with h(0) = 0.  A tangent meets
    h = -DEPTH outside the end that is looked for, so tangents close in on the end
    from outside; what is left beyond falls exponentially.
    """
    nb, r = family == "nb", F.lit(1.0) / a
    way = F.when(m > k + 1, 1.0).otherwise(-1.0)
    given = F.struct(
        nb.alias("nb"), (k + 1.0).alias("b"), m.alias("m"), r.alias("r"), (m / (r + m)).alias("q"), (r / (r + m)).alias("p"), way.alias("way")
    )

    def h(s: Column, v: Column) -> Column:
        poisson = s["b"] * v - s["m"] * F.expm1(v)
        by_q = s["b"] * v - (s["b"] + s["r"]) * F.log1p(s["q"] * F.expm1(v))
        # The same from the other end: what cancels is r v here, b v above.
        by_p = -s["r"] * v - (s["b"] + s["r"]) * F.log1p(s["p"] * F.expm1(-v))
        return F.when(~s["nb"], poisson).when(s["r"] > s["b"], by_q).otherwise(by_p)

    def slope(s: Column, v: Column) -> Column:
        poisson = s["b"] - s["m"] * F.exp(v)
        by_q = s["b"] - (s["b"] + s["r"]) * s["q"] * F.exp(v) / (F.lit(1.0) + s["q"] * F.expm1(v))
        by_p = (s["b"] + s["r"]) * s["p"] * F.exp(-v) / (F.lit(1.0) + s["p"] * F.expm1(-v)) - s["r"]
        return F.when(~s["nb"], poisson).when(s["r"] > s["b"], by_q).otherwise(by_p)

    def end(s: Column) -> Column:
        """Distance of the end from 0, at most FAR."""
        bend = F.when(s["nb"], (s["b"] + s["r"]) * s["q"] * s["p"]).otherwise(s["m"])
        step = lambda x, _: F.least(x - (h(s, s["way"] * x) + DEPTH) / (s["way"] * slope(s, s["way"] * x)), F.lit(FAR))
        return F.aggregate(F.expr("sequence(1, 6)"), F.least(F.sqrt(F.lit(2.0 * DEPTH) / bend), F.lit(FAR)), step)

    def log_factor(s: Column) -> Column:
        """ln of q^b (1 - q)^r / B(b, r), or of m^b e^-m / Gamma(b)."""
        b, m, r = s["b"], s["m"], s["r"]
        by_r = (r + 9.5) * F.log1p(F.lit(10.0) / r) - 10.0 + 10.0 * F.log(r) + _stirling(r + 10) - F.log(_shifted_product(r))
        beta = 0.5 * (F.log(b) - F.log1p(b / r)) + _stirling(b + r) - by_r - b * F.log1p((b - m) * r / ((b + r) * m)) - r * F.log1p((m - b) / (b + r))
        gamma = 0.5 * F.log(b) - b * F.log1p((b - m) / m) + b - m
        return F.when(s["nb"], beta).otherwise(gamma) - _stirling(b) - 0.5 * math.log(2 * math.pi)

    def integral(s: Column) -> Column:
        length, way = s["end"], s["s"]["way"]
        inside = F.aggregate(_nodes(), F.lit(0.0), lambda t, n: t + n["w"] * F.exp(h(s["s"], way * length * n["x"])))
        beyond = F.exp(h(s["s"], way * length)) / F.abs(slope(s["s"], way * length))
        return F.exp(log_factor(s["s"])) * (length * inside + beyond)

    return _let(given, lambda s: _let(F.struct(s.alias("s"), end(s).alias("end")), integral))


def _either_side(family: Column, k: Column, mu: Column, alpha: Column, floor: float, upper: bool) -> Column:
    m, a = F.greatest(mu, F.lit(floor)), F.greatest(F.coalesce(alpha, F.lit(1.0)), F.lit(floor))
    m, k = m.cast("double"), k.cast("double")
    small = _smaller_side(family, k, m, a)
    by_integral = _let(
        F.struct(small.alias("v"), ((m > k + 1) != F.lit(upper)).alias("asked")), lambda s: F.when(s["asked"], s["v"]).otherwise(F.lit(1.0) - s["v"])
    )
    summed = _sum_of_terms(family, k, m, a)
    by_sum = F.lit(1.0) - summed if upper else summed
    return F.when(k.isNull() | mu.isNull(), F.lit(None).cast("double")).when(k < 0, F.lit(1.0 if upper else 0.0)).when(k <= SUM_UP_TO, by_sum).otherwise(F.least(by_integral, F.lit(1.0)))


def cdf(family: Column, k: Column, mu: Column, alpha: Column, floor: float = FLOOR) -> Column:
    """P(Y <= k); 0 for negative k, null where k or mu is.  family is 'nb' or
    anything else for Poisson.  Small values keep their relative accuracy."""
    return _either_side(family, k, mu, alpha, floor, False)


def survival(family: Column, k: Column, mu: Column, alpha: Column, floor: float = FLOOR) -> Column:
    """P(Y > k); small values keep their relative accuracy for k > SUM_UP_TO."""
    return _either_side(family, k, mu, alpha, floor, True)


def crps(family: Column, y: Column, mu: Column, alpha: Column, k_max: Column) -> Column:
    """Sum over k = 0 .. k_max of (P(Y <= k) - [y <= k])^2."""
    m, a = F.greatest(mu, F.lit(FLOOR)), F.greatest(F.coalesce(alpha, F.lit(1.0)), F.lit(FLOOR))
    log0, ratio = _terms(family, m, a)
    miss = lambda f, k: F.pow(F.least(f, F.lit(1.0)) - F.when(y <= k, 1.0).otherwise(0.0), 2)
    start = F.struct(log0.alias("t"), F.exp(log0).alias("s"), miss(F.exp(log0), F.lit(0)).alias("q"))

    def step(x: Column, j: Column) -> Column:
        t = x["t"] + F.log(ratio(j))
        s = x["s"] + F.exp(t)
        return F.struct(t.alias("t"), s.alias("s"), (x["q"] + miss(s, j + 1)).alias("q"))

    return F.aggregate(_steps(k_max), start, step, lambda x: x["q"])


def randomised_pit(family: Column, y: Column, mu: Column, alpha: Column, u: Column, floor: float) -> Column:
    """F(y - 1) + u (F(y) - F(y - 1)), in [0, 1]."""
    ends = F.struct(cdf(family, y - 1, mu, alpha, floor).alias("below"), cdf(family, y, mu, alpha, floor).alias("at"), u.alias("u"))
    return _let(ends, lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["below"] + s["u"] * (s["at"] - s["below"]))))
