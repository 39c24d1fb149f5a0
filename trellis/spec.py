"""A grid is a DataFrame keyed by integers x, y, z from 0, with one column per field; GridSpec has what isn't data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class GridSpec:
    n: tuple[int, int, int]
    length: tuple[float, float, float] | None = None
    periodic: tuple[bool, bool, bool] = (True, True, True)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        if len(self.n) != 3 or min(self.n) < 1:
            raise ValueError("three sizes of at least 1")

    @property
    def spacing(self) -> tuple[float, float, float]:
        """Length over the number of intervals: n on a periodic axis, n - 1 otherwise; 1 without a length or on an inactive axis."""
        if self.length is None:
            return (1.0, 1.0, 1.0)
        return tuple(1.0 if k == 1 else s / (k if p else k - 1) for k, s, p in zip(self.n, self.length, self.periodic))

    @property
    def cells(self) -> int:
        return self.n[0] * self.n[1] * self.n[2]

    def active(self, axis: int) -> bool:
        return self.n[axis] > 1

    def keys(self, spark: SparkSession) -> DataFrame:
        nx, ny, _ = self.n
        i = F.col("id")
        return spark.range(self.cells).select((i % nx).cast("int").alias("x"), (F.expr(f"id div {nx}") % ny).cast("int").alias("y"), F.expr(f"id div {nx * ny}").cast("int").alias("z"))

    def dense(self, df: DataFrame, fill: float = 0.0) -> DataFrame:
        """Every cell, those that df hasn't filled up."""
        return self.keys(df.sparkSession).join(df, list(AXES), "left").fillna(fill)

    def position(self, axis: int) -> Column:
        return F.col(AXES[axis]) * F.lit(float(self.spacing[axis])) + F.lit(float(self.origin[axis]))

    def center(self) -> tuple[float, float, float]:
        return tuple(o + d * (k - 1) / 2 for o, d, k in zip(self.origin, self.spacing, self.n))

    def coarse(self) -> GridSpec:
        return replace(self, n=tuple(max(1, (k + 1) // 2) for k in self.n))

    def inside(self) -> Column:
        cond = F.lit(True)
        for a, k in zip(AXES, self.n):
            cond = cond & (F.col(a) >= 0) & (F.col(a) < k)
        return cond
