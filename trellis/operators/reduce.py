"""Reductions to scalars and profiles: aggregates with a map before and a post-operation after them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import AXES, GridSpec

Fields = Sequence[str]


def norm(fields: Fields) -> Column:
    """Of one field itself, of three their Euclidean length."""
    return F.col(fields[0]) if len(fields) == 1 else F.sqrt(square(fields))


def square(fields: Fields) -> Column:
    out = F.col(fields[0]) * F.col(fields[0])
    for f in fields[1:]:
        out = out + F.col(f) * F.col(f)
    return out


def exp_square(fields: Fields) -> Column:
    out = F.exp(F.col(fields[0])) * F.exp(F.col(fields[0]))
    for f in fields[1:]:
        out = out + F.exp(F.col(f)) * F.exp(F.col(f))
    return out


def alfven_square(fields: Fields) -> Column:
    """Of a magnetic field and a log density: |B|^2 / rho."""
    return square(fields[:3]) / F.exp(F.col(fields[3]))


def alfven(fields: Fields) -> Column:
    return F.sqrt(alfven_square(fields))


def distance(spec: GridSpec) -> Column:
    c = spec.center()
    return F.sqrt(sum(((spec.position(a) - F.lit(c[a])) ** 2 for a in range(3)), F.lit(0.0)))


def radial(spec: GridSpec, radius: float) -> Column:
    return F.when(distance(spec) <= radius, 1.0).otherwise(0.0)


def gaussian(spec: GridSpec, radius: float) -> Column:
    return F.exp(-((distance(spec) / radius) ** 2))


@dataclass(frozen=True)
class Reduction:
    op: str
    map: object = norm
    window: object = None
    post: str = ""


#: By name. A window weighs the mapped value; post is taken of the result.
REDUCTIONS = {
    "max": Reduction("max"), "min": Reduction("min"), "sum": Reduction("sum"),
    "rms": Reduction("sum", square, post="rms"), "rms_exp": Reduction("sum", exp_square, post="rms"),
    "alfven_max": Reduction("max", alfven), "alfven_min": Reduction("min", alfven), "alfven_rms": Reduction("sum", alfven_square, post="rms"),
    "alfven_radial_max": Reduction("max", alfven, radial), "alfven_radial_min": Reduction("min", alfven, radial),
    "alfven_radial_sum": Reduction("sum", alfven_square, radial), "alfven_radial_rms": Reduction("sum", alfven_square, radial, "radial_rms"),
    "radial_max": Reduction("max", norm, radial), "radial_min": Reduction("min", norm, radial), "radial_sum": Reduction("sum", norm, radial),
    "gaussian_max": Reduction("max", norm, gaussian), "gaussian_min": Reduction("min", norm, gaussian), "gaussian_sum": Reduction("sum", norm, gaussian),
}


def expression(kind: str, fields: Fields, spec: GridSpec, radius: float | None = None) -> Column:
    """The aggregate of that name; many of them fit in one agg()."""
    r = REDUCTIONS[kind]
    v = r.map(fields)
    if r.window:
        v = v * r.window(spec, radius)
    out = {"max": F.max, "min": F.min, "sum": F.sum}[r.op](v)
    volume = spec.spacing[0] * spec.spacing[1] * spec.spacing[2]
    if r.post == "rms":
        out = F.sqrt(out / spec.cells)
    elif r.post == "radial_rms":
        out = F.sqrt(out / int(4 / 3 * pi * radius**3 / volume))
    return out


def scalars(grid: DataFrame, spec: GridSpec, wanted: dict[str, tuple], by: Sequence[str] = ()) -> DataFrame:
    """wanted: {column: (reduction, fields[, radius])}. by: subdomain columns, for one row for each instead of one in all."""
    aggs = [expression(k, (f,) if isinstance(f, str) else f, spec, *r).alias(name) for name, (k, f, *r) in wanted.items()]
    return grid.groupBy(*by).agg(*aggs) if by else grid.agg(*aggs)


def l2_norm(field: str, spec: GridSpec) -> Column:
    """Square root of the integral of the square: no mean."""
    return F.sqrt(F.sum(F.col(field) * F.col(field) * F.lit(float(spec.spacing[0] * spec.spacing[1] * spec.spacing[2]))))


def has_nan(field: str) -> Column:
    return F.max(F.isnan(F.col(field)))


PROFILES = ("x", "y", "z", "xy", "xz", "yx", "yz", "zx", "zy")


def profile(grid: DataFrame, axes: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates by one axis or two; yx is xy with the columns the other way round."""
    if axes not in PROFILES:
        raise ValueError(f"profiles are {', '.join(PROFILES)}")
    return grid.groupBy(*axes).agg(*(v.alias(k) for k, v in aggs.items()))


def profiles(grid: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """All profiles and the scalar in one pass: grouping sets of up to two axes; axes that a row sums over are null."""
    sets = [[F.col(a) for a in c] for k in (2, 1, 0) for c in combinations(AXES, k)]
    return grid.groupingSets(sets, *(F.col(a) for a in AXES)).agg(*(v.alias(k) for k, v in aggs.items()))


def with_profile(grid: DataFrame, prof: DataFrame, axes: str) -> DataFrame:
    """Each cell with the profile's row. Spark broadcasts the profile if its size allows, and shuffles both otherwise."""
    return grid.join(prof, list(axes))


def band(grid: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Cells with x, y, z in the half-open ranges: sub-volumes, slices, boundary plates. A filter that reaches the scan."""
    for a, (lo, hi) in ranges.items():
        grid = grid.where((F.col(a) >= lo) & (F.col(a) < hi))
    return grid


def mid_slice(grid: DataFrame, spec: GridSpec) -> DataFrame:
    return grid.where(F.col("z") == spec.n[2] // 2)


def transposed(grid: DataFrame, order: str) -> DataFrame:
    """Axes renamed: order 'zyx' makes the old z the new x."""
    fields = [c for c in grid.columns if c not in AXES]
    return grid.select(*(F.col(o).alias(a) for o, a in zip(order, AXES)), *fields)


def scatter_add(grid: DataFrame, targets: Sequence[Column], value: Column, names: Sequence[str], out: str) -> DataFrame:
    """Sums of value by computed target."""
    return grid.groupBy(*(t.alias(n) for t, n in zip(targets, names))).agg(F.sum(value).alias(out))


def gather(grid: DataFrame, lookup: DataFrame, at: dict[str, Column], value: str, out: str) -> DataFrame:
    """lookup's value at computed keys; null where there is none."""
    keyed = grid.withColumns({f"_{k}": c for k, c in at.items()})
    other = lookup.select(*(F.col(k).alias(f"_{k}") for k in at), F.col(value).alias(out))
    return keyed.join(other, [f"_{k}" for k in at], "left").drop(*(f"_{k}" for k in at))
