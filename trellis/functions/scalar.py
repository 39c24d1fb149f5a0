"""Scalar functions of columns, with the edge cases of the C functions they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mod(a: Column, b: Column | float) -> Column:
    """Truncated: the sign of a."""
    b = b if isinstance(b, Column) else F.lit(b)
    q = a / b
    return a - b * F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))


def modulo(a: Column, b: Column | float) -> Column:
    """Floored: the sign of b."""
    b = b if isinstance(b, Column) else F.lit(b)
    return a - b * F.floor(a / b)


def nint(a: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.when(a < 0, -F.floor(-a + 0.5)).otherwise(F.floor(a + 0.5))


def sign(value: Column, s: Column) -> Column:
    """|value| with the sign of s."""
    return F.when(s < 0, -F.abs(value)).otherwise(F.abs(value))


def log(a: Column) -> Column:
    """Natural logarithm: -infinity at 0 and NaN below, where Spark has null."""
    return F.when(a > 0, F.log(a)).when(a == 0, F.lit(float("-inf"))).otherwise(F.when(a.isNull(), None).otherwise(F.lit(float("nan"))))


def set_min(a: Column, low: float) -> Column:
    return F.when(a < low, F.lit(float(low))).otherwise(a)


def set_max(a: Column, high: float) -> Column:
    return F.when(a > high, F.lit(float(high))).otherwise(a)


def zero_below(a: Column, threshold: float) -> Column:
    return F.when(F.abs(a) < threshold, F.lit(0.0)).otherwise(a)


def tanh_step(x: Column, at: float, width: float) -> Column:
    return 0.5 * (1 + F.tanh((x - at) / width))


def quintic_step(x: Column, at: float, width: float) -> Column:
    """0 to 1 over the width around `at`, with continuous second derivatives."""
    t = F.least(F.greatest((x - at) / width + 0.5, F.lit(0.0)), F.lit(1.0))
    return t * t * t * (10 - 15 * t + 6 * t * t)


def minmod(a: Column, b: Column) -> Column:
    return F.when(a * b <= 0, F.lit(0.0)).otherwise(F.when(F.abs(a) < F.abs(b), a).otherwise(b))


def minmod3(a: Column, b: Column, c: Column) -> Column:
    return minmod(a, minmod(b, c))


def colour(count: int, which: int, offset: int = 0) -> Column:
    """Whether (x + y + z) mod count is `which`; offset moves the origin, as where halo cells are counted."""
    return F.pmod(F.col("x") + F.col("y") + F.col("z") + offset, F.lit(count)) == which


def narrowed(a: Column) -> Column:
    """Through single precision."""
    return a.cast("float").cast("double")
