"""Spherical-harmonic moments of a source, and the potential outside and inside that they give."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import GridSpec


def _place(spec: GridSpec) -> tuple[Column, Column, Column]:
    """Radius, cosine of the colatitude, longitude, from the box's centre."""
    x, y, z = (spec.position(a) - F.lit(c) for a, c in enumerate(spec.center()))
    r = F.sqrt(x * x + y * y + z * z)
    return r, F.when(r > 0, z / r).otherwise(F.lit(1.0)), F.atan2(y, x)


def legendre(degree: int, order: int, c: Column) -> Column:
    """Associated Legendre function without the alternating sign, by its two recurrences."""
    s = F.sqrt(F.greatest(1 - c * c, F.lit(0.0)))
    p = F.lit(1.0)
    for k in range(1, order + 1):
        p = p * (2 * k - 1) * s
    if degree == order:
        return p
    before, p = p, c * (2 * order + 1) * p
    for l in range(order + 2, degree + 1):
        before, p = p, ((2 * l - 1) * c * p - (l + order - 1) * before) / (l - order)
    return p


def harmonic(degree: int, order: int, c: Column, phi: Column) -> Column:
    """Real, orthonormal; negative orders are the sines."""
    m = abs(order)
    n = math.sqrt((2 * degree + 1) / (4 * math.pi) * math.factorial(degree - m) / math.factorial(degree + m))
    p = legendre(degree, m, c) * (n * (math.sqrt(2) if m else 1))
    return p * (F.cos(m * phi) if order > 0 else F.sin(m * phi)) if m else p


def moments(grid: DataFrame, spec: GridSpec, source: str, degree: int, inner: bool = False, radius: float | None = None) -> DataFrame:
    """One row: q_<l>_<m> = sum of source * r^l * Y_lm * cell volume over cells within the radius (inner: r^-(l+1), beyond it)."""
    r, c, phi = _place(spec)
    volume = spec.spacing[0] * spec.spacing[1] * spec.spacing[2]
    inside = F.lit(True) if radius is None else (r > radius if inner else r <= radius)
    aggs = []
    for l in range(degree + 1):
        power = F.pow(F.greatest(r, F.lit(1e-300)), F.lit(float(-(l + 1)))) if inner else F.pow(r, F.lit(float(l)))
        for m in range(-l, l + 1):
            aggs.append(F.sum(F.when(inside, F.col(source) * power * harmonic(l, m, c, phi) * volume).otherwise(0.0)).alias(f"q_{l}_{m}"))
    return grid.agg(*aggs)


def potential(grid: DataFrame, spec: GridSpec, found: DataFrame, degree: int, out: str, inner: bool = False) -> DataFrame:
    """The potential of -Laplacian = source that the moments give beyond the source (inner: within a hollow)."""
    r, c, phi = _place(spec)
    row = found.first().asDict()  # (degree + 1)^2 numbers
    total = F.lit(0.0)
    for l in range(degree + 1):
        power = F.pow(r, F.lit(float(l))) if inner else F.pow(F.greatest(r, F.lit(1e-300)), F.lit(float(-(l + 1))))
        for m in range(-l, l + 1):
            total = total + F.lit(float(row[f"q_{l}_{m}"] or 0.0) / (2 * l + 1)) * power * harmonic(l, m, c, phi)
    return grid.withColumn(out, total)
