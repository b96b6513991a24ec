"""Arithmetic with NULL for "undefined", and order-free draws."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(col(a), col(b))


def z_beyond(x: Column, mean: Column, sd: Column, threshold: float) -> Column:
    """|x - mean| / sd > threshold, where a zero deviation makes any other value infinitely far."""
    return F.coalesce(
        F.when(sd > 0, F.abs(x - mean) / sd > F.lit(float(threshold))).when(sd == 0, x != mean),
        F.lit(False),
    )


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd with IEEE infinities for a zero deviation and NULL for 0/0."""
    return (
        F.when(sd > 0, (x - mean) / sd)
        .when((sd == 0) & (x > mean), F.lit(INF))
        .when((sd == 0) & (x < mean), F.lit(-INF))
    )


def is_flat(mean: Column, sd: Column) -> Column:
    """A deviation too small, next to the mean, to divide by."""
    return sd < F.lit(1e-15) * (F.abs(mean) + F.lit(1e-300))


# Hart's rational approximation of the normal tail, as published by G. West,
# "Better approximations to cumulative normal functions" (2005).
_TAIL_TOP = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_TAIL_BOTTOM = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    x = F.least(F.abs(z), F.lit(37.0))
    gauss = F.exp(-x * x / 2)
    near = gauss * _horner(x, _TAIL_TOP) / _horner(x, _TAIL_BOTTOM)
    fraction = x + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(k) / fraction
    far = gauss / fraction / F.lit(2.506628274631)
    tail = F.when(x < F.lit(7.07106781186547), near).otherwise(far)
    return F.when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def uniform(*parts: Column | str | int) -> Column:
    """A draw in [0, 1) from the hash of the parts: the same on any partitioning or engine."""
    text = F.concat_ws("|", *[F.lit(p).cast("string") if isinstance(p, int) else col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def tick_order(us: Column, tie: Column) -> Column:
    """(time, tie-break id) as one DECIMAL.

    min_by/max_by on a struct would plan a sort before the partial aggregate; a fixed-width number
    keeps it a hash aggregate. Ids must be in [0, 10^19).
    """
    return us.cast("decimal(19,0)") * F.lit(Decimal(10**19)) + tie.cast("decimal(19,0)")
