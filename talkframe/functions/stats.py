"""Tails of test statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_gamma_half(dof: Column) -> Column:
    """ln Gamma(dof / 2) of a whole dof, as the sum of the logarithms of its factors."""
    factors = F.sequence(F.lit(0), F.greatest((dof - 1).cast("int"), F.lit(1)))
    even = F.aggregate(factors, F.lit(0.0), lambda acc, i: acc + F.when((i > 0) & (i < dof / 2), F.log(F.greatest(i, F.lit(1)).cast("double"))).otherwise(0.0))
    odd = F.aggregate(factors, F.lit(math.log(math.pi) / 2), lambda acc, i: acc + F.when(i < (dof - 1) / 2, F.log(i + 0.5)).otherwise(0.0))
    return F.when(dof % 2 == 0, even).otherwise(odd)


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X > x) of a chi-square variable: the regularised upper incomplete gamma function at (dof / 2, x / 2).

    Below a + 1 the power series of the lower function is summed, above it the continued fraction of the upper one is evaluated from
    its front. Both take a number of terms that grows with the root of ``dof``. Null without degrees of freedom.
    """
    a, z = dof / F.lit(2.0), F.greatest(x / F.lit(2.0), F.lit(0.0))
    steps = F.sequence(F.lit(1), (F.lit(100) + 10 * F.sqrt(a)).cast("int"))
    front = F.when(z > 0, F.exp(a * F.log(F.greatest(z, F.lit(1e-300))) - z - _log_gamma_half(dof))).otherwise(F.lit(0.0))
    series = F.aggregate(
        steps, F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * z / (a + i)).alias("term"), (acc["sum"] + acc["term"] * z / (a + i)).alias("sum")),
        lambda acc: acc["sum"])
    first = z + 1.0 - a
    tiny = F.lit(1e-300)

    def safe(c: Column) -> Column:
        return F.when(F.abs(c) < tiny, tiny).otherwise(c)

    def step(acc: Column, i: Column) -> Column:
        num, b = -i * (i - a), first + 2 * i
        d = F.lit(1.0) / safe(num * acc["d"] + b)
        c = safe(b + num / acc["c"])
        return F.struct(d.alias("d"), c.alias("c"), (acc["h"] * d * c).alias("h"))

    start = F.lit(1.0) / safe(first)
    fraction = F.aggregate(steps, F.struct(start.alias("d"), F.lit(1e300).alias("c"), start.alias("h")), step, lambda acc: acc["h"])
    p = F.when(z < a + 1, F.lit(1.0) - front * series).otherwise(front * fraction)
    return F.when(dof > 0, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def kolmogorov_tail(gap: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov gap: the alternating series of exp(-2 j^2 z^2), z = gap * root of the
    harmonic sample size. Below z = 0.1, where the tail is 1 to all digits, the series is not needed."""
    z = gap * F.sqrt(F.try_divide(n_a.cast("double") * n_b, n_a + n_b))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * z * z))
    return F.when(z < 0.1, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
