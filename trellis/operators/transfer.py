"""Between fine and coarse grids: restriction and prolongation as keyed aggregations."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import AXES, GridSpec


def _axis(spec: GridSpec, axis: int, w: dict[int, float]) -> dict[int, float]:
    return w if spec.active(axis) else {0: 1.0}


def restrict(grid: DataFrame, spec: GridSpec, fields: tuple[str, ...], even: bool = False) -> DataFrame:
    """Full weighting to a grid of half the cells. Odd: (1, 2, 1)/4 around cell 2i; even: (1, 3, 3, 1)/8 over cells 2i-1 to 2i+2."""
    w = {-1: 0.125, 0: 0.375, 1: 0.375, 2: 0.125} if even else {-1: 0.25, 0: 0.5, 1: 0.25}
    taps = [(t, a * b * c) for t, a, b, c in _product(spec, w)]
    tap = F.explode(F.array(*(F.struct(*(F.lit(k).alias(f"d{a}") for a, k in zip(AXES, t)), F.lit(c).alias("c")) for t, c in taps)))
    sent = grid.select(*AXES, *fields, tap.alias("_t"))
    to = []
    for k, a in enumerate(AXES):
        at = F.col(a) - F.col(f"_t.d{a}")
        to.append((F.pmod(at, F.lit(spec.n[k])) if spec.periodic[k] and spec.active(k) else at).cast("int").alias(a))
    sent = sent.select(*to, *fields, F.col("_t.c").alias("_c")).where(spec.inside())
    for k, a in enumerate(AXES):
        if spec.active(k):
            sent = sent.where(F.col(a) % 2 == 0).withColumn(a, (F.col(a) / 2).cast("int"))
    return sent.groupBy(*AXES).agg(*(F.sum(F.col(f) * F.col("_c")).alias(f) for f in fields))


def _product(spec: GridSpec, w: dict[int, float]):
    axes = [_axis(spec, a, w) for a in range(3)]
    for t in product(*axes):
        yield t, *(axes[a][t[a]] for a in range(3))


def prolong(grid: DataFrame, fine: GridSpec, fields: tuple[str, ...], even: bool = False) -> DataFrame:
    """Linear interpolation to the fine grid. Odd: cell 2i is i, cell 2i+1 the mean of i and i+1; even: (3, 1)/4 of the nearest two."""
    w = {-1: 0.25, 0: 0.75, 1: 0.75, 2: 0.25} if even else {-1: 0.5, 0: 1.0, 1: 0.5}
    taps = [(t, a * b * c) for t, a, b, c in _product(fine, w)]
    tap = F.explode(F.array(*(F.struct(*(F.lit(k).alias(f"d{a}") for a, k in zip(AXES, t)), F.lit(c).alias("c")) for t, c in taps)))
    sent = grid.select(*AXES, *fields, tap.alias("_t"))
    to = []
    for k, a in enumerate(AXES):
        at = F.col(a) * (2 if fine.active(k) else 1) + F.col(f"_t.d{a}")
        to.append((F.pmod(at, F.lit(fine.n[k])) if fine.periodic[k] and fine.active(k) else at).cast("int").alias(a))
    sent = sent.select(*to, *fields, F.col("_t.c").alias("_c")).where(fine.inside())
    return sent.groupBy(*AXES).agg(*(F.sum(F.col(f) * F.col("_c")).alias(f) for f in fields))
