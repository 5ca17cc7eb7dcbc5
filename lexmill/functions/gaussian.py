"""Log densities and log tails of the normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the upper tail below
# 5 * sqrt(2), as published by West (highest power first).
TAIL_NUMERATOR = [
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
TAIL_DENOMINATOR = [
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
TAIL_CUT = 7.07106781186547
HALF_LOG_TWO_PI = 0.918938533204673


def _polynomial(z: Column, coefficients: list[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * z + F.lit(c)
    return total


def log_tail(z: Column) -> Column:
    """``ln(1 - cdf(|z|))``; finite for every finite z because the square is kept in the log."""
    z = F.abs(z)
    near = F.ln(_polynomial(z, TAIL_NUMERATOR) / _polynomial(z, TAIL_DENOMINATOR))
    fraction = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = z + F.lit(k) / fraction
    far = -F.ln(fraction) - F.lit(HALF_LOG_TWO_PI)
    return -z * z / 2.0 + F.when(z < TAIL_CUT, near).otherwise(far)


def log_density(z: Column, sd: Column) -> Column:
    """Log of the normal density at ``z`` standard deviations."""
    return -z * z / 2.0 - F.ln(sd) - F.lit(HALF_LOG_TWO_PI)
