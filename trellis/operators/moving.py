"""Grids whose cells carry their own coordinates: gradients on them, and coordinates beyond periodic faces."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import determinant, total
from ..spec import AXES, GridSpec
from . import stencil as S
from .boundary import Condition, extend


def coordinate_ghosts(grid: DataFrame, spec: GridSpec, coordinates: dict[int, str], fields: tuple[str, ...], axis: int, depth: int) -> DataFrame:
    """Periodic layers beyond the axis's faces; the axis's coordinate goes on past the box instead of jumping back."""
    names = (*coordinates.values(), *fields)
    out = extend(grid, spec, {f: Condition("periodic") for f in names}, axis, depth)
    if axis not in coordinates:
        return out
    size, c = spec.spacing[axis] * spec.n[axis], coordinates[axis]
    k = F.col(AXES[axis])
    return out.withColumn(c, F.col(c) + F.when(k < 0, -size).when(k >= spec.n[axis], size).otherwise(0.0))


def _det(m: list[list[Column]]) -> Column:
    return m[0][0] if len(m) == 1 else m[0][0] * m[1][1] - m[0][1] * m[1][0] if len(m) == 2 else determinant(m)


def average_gradient(grid: DataFrame, spec: GridSpec, coordinates: dict[int, str], field: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """grad_x, grad_y, ... of a field on cells with coordinates {axis: column}, by averages over the planes through neighbours.

    For each choice of one neighbour along every axis, the plane through the cell and these neighbours has a gradient; the
    mean is weighted by the signed area or volume that they span. Along periodic axes the nearest image of a neighbour counts.
    """
    axes = sorted(coordinates)
    taps = {f"_{c}_{a}_{s}": (S.Stencil.of({S._on(a, s): 1.0, (0, 0, 0): -1.0}), c) for c in (*coordinates.values(), field) for a in axes for s in (-1, 1)}
    g = S.apply(grid, spec, taps, keep)

    def step(c: str, a: int, s: int) -> Column:
        d = F.col(f"_{c}_{a}_{s}")
        own = next((k for k, v in coordinates.items() if v == c), None)
        if own is None or not spec.periodic[own]:
            return d
        size = spec.spacing[own] * spec.n[own]
        return d - size * F.round(d / size)

    volumes, parts = [], {a: [] for a in axes}
    for signs in product((-1, 1), repeat=len(axes)):
        parity = 1.0
        for s in signs:
            parity *= s
        rows = [[step(coordinates[b], a, s) for b in axes] for a, s in zip(axes, signs)]
        rise = [step(field, a, s) for a, s in zip(axes, signs)]
        volumes.append(_det(rows) * parity)
        for k, a in enumerate(axes):
            parts[a].append(_det([[v if j == k else x for j, x in enumerate(r)] for r, v in zip(rows, rise)]) * parity)
    whole = total(volumes)
    return g.select(*AXES, *keep, *((total(parts[a]) / whole).alias(f"grad_{AXES[a]}") for a in axes))
