"""Interval estimates and tests for proportions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.columns import col

# Chebyshev coefficients of the complementary error function
# (relative error below 1.2e-7 everywhere; Press et al., Numerical Recipes, 6.2).
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def two_sided_p(z: str | Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z; Spark has no erfc of its own."""
    x = F.abs(col(z)) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x / F.lit(2.0))
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(poly - x * x)


def wilson(successes: str | Column, n: str | Column, z: float = 1.96) -> Column:
    """Wilson score interval as ``struct(lo, hi)``; NULL bounds when n is zero."""
    size = col(n).cast("double")
    p = F.try_divide(col(successes).cast("double"), size)
    zz = F.lit(z * z)
    denominator = F.lit(1.0) + F.try_divide(zz, size)
    centre = F.try_divide(p + F.try_divide(zz, F.lit(2.0) * size), denominator)
    spread = F.sqrt(F.try_divide(p * (F.lit(1.0) - p), size) + F.try_divide(zz, F.lit(4.0) * size * size))
    half = F.try_divide(F.lit(z) * spread, denominator)
    return F.struct((centre - half).alias("lo"), (centre + half).alias("hi"))


def two_prop_ztest(x1: str | Column, n1: str | Column, x2: str | Column, n2: str | Column) -> Column:
    """Two-sided z-test of two proportions with a pooled standard error: ``struct(diff, z, p)``.

    z and p are NULL where there is no variance to test against: every or no unit
    succeeded, or (in an open funnel) more reached the step than the one before it.
    """
    a, b = col(x1).cast("double"), col(x2).cast("double")
    m, n = col(n1).cast("double"), col(n2).cast("double")
    diff = F.try_divide(a, m) - F.try_divide(b, n)
    pooled = F.try_divide(a + b, m + n)
    variance = pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), m) + F.try_divide(F.lit(1.0), n))
    z = diff / F.when(variance > 0, F.sqrt(variance))
    return F.struct(diff.alias("diff"), z.alias("z"), two_sided_p(z).alias("p"))
