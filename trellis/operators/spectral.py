"""Fourier transforms, one axis after another, and what is simple in wave space.

A pass groups cells into pencils, several lines to a group, and transforms them with numpy: a task holds its
pencils, never the grid. Forward transforms are divided by the number of cells, backward ones are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import AXES, GridSpec

#: Cells of a group, about.
PENCILS = 1 << 18


def _pass(df: DataFrame, spec: GridSpec, axis: int, re: str, im: str, inverse: bool) -> DataFrame:
    n, name = spec.n[axis], AXES[axis]
    a, b = (k for k in range(3) if k != axis)
    lines = F.col(AXES[a]) + F.col(AXES[b]) * spec.n[a]
    group = F.expr(f"({AXES[a]} + {AXES[b]} * {spec.n[a]}) div {max(1, PENCILS // n)}")

    def run(t: pa.Table) -> pa.Table:
        line, first = np.unique(t.column("_line").to_numpy(), return_inverse=True)
        v = np.zeros((len(line), n), complex)
        at = (first, t.column(name).to_numpy())
        v[at] = t.column(re).to_numpy() + 1j * t.column(im).to_numpy()
        out = np.fft.ifft(v, axis=1) * n if inverse else np.fft.fft(v, axis=1) / n
        key = np.repeat(line, n)
        cols = {name: np.tile(np.arange(n), len(line)), AXES[a]: key % spec.n[a], AXES[b]: key // spec.n[a]}
        return pa.table({k: pa.array(cols[k].astype(np.int32)) for k in AXES} | {re: pa.array(out.real.ravel()), im: pa.array(out.imag.ravel())})

    keyed = df.select(*AXES, re, im, lines.cast("long").alias("_line"), group.alias("_g"))
    return keyed.groupBy("_g").applyInArrow(run, f"x int, y int, z int, `{re}` double, `{im}` double")


def fft(df: DataFrame, spec: GridSpec, re: str = "re", im: str = "im", inverse: bool = False, axes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Complex to complex over the axes given; axes (0, 1) is the planar transform."""
    for a in axes:
        if spec.active(a):
            df = _pass(df, spec, a, re, im, inverse)
    return df


def forward(grid: DataFrame, spec: GridSpec, field: str, axes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Real to complex, all wave numbers."""
    return fft(grid.select(*AXES, F.col(field).cast("double").alias("re"), F.lit(0.0).alias("im")), spec, axes=axes)


def half(spectrum: DataFrame, spec: GridSpec) -> DataFrame:
    """The half of a real field's spectrum that has all of it: x wave numbers from 0 to n/2."""
    return spectrum.where(F.col("x") <= spec.n[0] // 2)


def whole(spectrum: DataFrame, spec: GridSpec) -> DataFrame:
    """The other half again, by conjugate symmetry."""
    n = spec.n
    mirrored = spectrum.where((F.col("x") > 0) & (F.col("x") * 2 < n[0])).select(
        *((F.pmod(-F.col(a), F.lit(k))).cast("int").alias(a) for a, k in zip(AXES, n)), "re", (-F.col("im")).alias("im"))
    return spectrum.unionByName(mirrored)


def backward(spectrum: DataFrame, spec: GridSpec, field: str, axes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Complex to real."""
    return fft(spectrum, spec, inverse=True, axes=axes).select(*AXES, F.col("re").alias(field))


def wave_number(spec: GridSpec, axis: int) -> Column:
    n, length = spec.n[axis], spec.spacing[axis] * spec.n[axis]
    k = F.col(AXES[axis])
    return F.when(k * 2 <= n, k).otherwise(k - n) * F.lit(2 * np.pi / length)


def wave_square(spec: GridSpec) -> Column:
    return sum((wave_number(spec, a) ** 2 for a in range(3)), F.lit(0.0))


def scaled(spectrum: DataFrame, by: Column) -> DataFrame:
    return spectrum.withColumns({"re": F.col("re") * by, "im": F.col("im") * by})


def poisson(grid: DataFrame, spec: GridSpec, field: str, out: str) -> DataFrame:
    """The field of mean 0 whose Laplacian is the given one, less its mean."""
    k2 = wave_square(spec)
    return backward(scaled(forward(grid, spec, field), F.when(k2 == 0, 0.0).otherwise(-1 / k2)), spec, out)


def diffuse(grid: DataFrame, spec: GridSpec, field: str, diffusivity: float, dt: float, out: str) -> DataFrame:
    """Exact diffusion over a time dt."""
    return backward(scaled(forward(grid, spec, field), F.exp(-F.lit(diffusivity * dt) * wave_square(spec))), spec, out)


def potential(plane: DataFrame, spec: GridSpec, field: str, height: float, out: str) -> DataFrame:
    """A plane's field continued to a height above it without sources between: each wave falls off by its own number."""
    k = F.sqrt(wave_number(spec, 0) ** 2 + wave_number(spec, 1) ** 2)
    return backward(scaled(forward(plane, spec, field, (0, 1)), F.exp(-k * height)), spec, out, (0, 1))


def shifted(spectrum: DataFrame, spec: GridSpec, axis: int, by: float) -> DataFrame:
    """The spectrum of the field moved by a distance along the axis."""
    p = wave_number(spec, axis) * F.lit(float(by))
    re, im = F.col("re"), F.col("im")
    return spectrum.withColumns({"re": re * F.cos(p) + im * F.sin(p), "im": im * F.cos(p) - re * F.sin(p)})
