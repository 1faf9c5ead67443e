"""Standard normal distribution as plain arithmetic on columns.

The tail uses Hart's rational approximation in the double-precision form published by
G. West, "Better approximations to cumulative normal functions" (2005).
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published approximation, highest power first.
NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
SPLIT = 7.07106781186547
ROOT_TWO_PI = 2.506628274631
CUTOFF = 37.0


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        total = total * x + F.lit(coefficient)
    return total


def upper_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0."""
    density = F.exp(-x * x / 2.0)
    near = density * _polynomial(x, NUMERATOR) / _polynomial(x, DENOMINATOR)
    fraction = x + F.lit(0.65)
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(step) / fraction
    far = density / fraction / F.lit(ROOT_TWO_PI)
    return F.when(x > CUTOFF, 0.0).when(x < SPLIT, near).when(x >= SPLIT, far)


def cdf(z: Column) -> Column:
    tail = upper_tail(F.abs(z))
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def two_sided_p(z: Column) -> Column:
    return F.lit(2.0) * upper_tail(F.abs(z))


def quantile(p: float) -> float:
    """Quantile of a constant probability; evaluated once while the plan is built."""
    return NormalDist().inv_cdf(p)
