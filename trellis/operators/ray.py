"""Rays: ordered scans along lattice lines.

Cells of a line share a key, so a line is one window partition or part of a bundle of lines, as long as the grid's longest axis.
On an axis that is periodic, rays leave at one face and come in at the other; such a line closes on itself, and its start
value follows from going round once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..spec import AXES, GridSpec

Direction = tuple[int, int, int]
LETTER = {1: "p", 0: "z", -1: "m"}
#: The 26 directions by name: a letter for x, y and z each (plus, zero, minus), and the six along axes by their own names.
DIRECTIONS: dict[str, Direction] = {"".join(LETTER[k] for k in d): d for d in product((-1, 0, 1), repeat=3) if any(d)} | {
    "right": (1, 0, 0), "left": (-1, 0, 0), "up": (0, 1, 0), "down": (0, -1, 0), "forwards": (0, 0, 1), "backwards": (0, 0, -1)}


def line_keys(direction: Direction) -> tuple[list[Column], Column]:
    """Columns that a line's cells share, and the column that orders them along the ray."""
    if not any(direction):
        raise ValueError("a ray has a direction")
    lead = max(a for a in range(3) if direction[a])
    step = F.col(AXES[lead]) * direction[lead]
    return [(F.col(AXES[a]) - direction[a] * step).alias(f"_l{a}") for a in range(3) if a != lead], step


def _window(direction: Direction):
    keys, step = line_keys(direction)
    return Window.partitionBy(*keys).orderBy(step)


def incoming(value: Column, direction: Direction, default: float | None = None) -> Column:
    """The value at the cell that the ray comes from; default on the face where it comes in."""
    return F.lag(value, 1, default).over(_window(direction))


def outgoing(value: Column, direction: Direction, default: float | None = None) -> Column:
    return F.lead(value, 1, default).over(_window(direction))


def running(value: Column, direction: Direction, inclusive: bool = True) -> Column:
    """Sum along the ray up to each cell."""
    w = _window(direction).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0))


def at_entry(value: Column, direction: Direction) -> Column:
    """The value at the cell where the line comes in."""
    return F.first(value).over(_window(direction).rowsBetween(Window.unboundedPreceding, 0))


def recurrences(grid: DataFrame, direction: Direction, columns: Mapping[str, tuple[Column, Column, Column]], closed: bool = False, bundles: int | None = None) -> DataFrame:
    """grid and a column for each name: Q = a * Q_before + b along the ray, given as (a, b, Q_before at the entry).

    Lines are dealt to bundles; in a bundle all lines advance together, a step being a few array operations, so the cost is in
    proportion to the cells. closed: lines close on themselves, and the start is the value that going round once gives again,
    S / (1 - product of a), S being the last value from a start of 0; a of any sign.
    """
    keys, step = line_keys(direction)
    names = list(columns)
    bundles = bundles or 8 * int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = grid.select("*", F.xxhash64(*keys).alias("_line"), step.cast("long").alias("_step"), *(c.cast("double").alias(f"_{x}_{n}") for n, abc in columns.items() for x, c in zip("abs", abc)))
    d = d.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)), F.pmod("_line", F.lit(bundles)).alias("_bundle"))
    kept = grid.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("_k0", "ascending"), ("_k1", "ascending"), ("_step", "ascending")])
        k = [t.column(c).to_numpy() for c in ("_k0", "_k1")]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(k[0]) != 0) | (np.diff(k[1]) != 0))))
        length = np.diff(np.append(first, len(t)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        out = t.select(kept)
        for n in names:
            a, b, s = (t.column(f"_{x}_{n}").to_numpy(zero_copy_only=False) for x in "abs")
            value, product = np.empty(len(t)), np.empty(len(t))
            q, p = np.zeros(len(first)) if closed else s[first].astype(float), np.ones(len(first))
            for i in range(int(length[0])):
                going = int(np.searchsorted(-length, -i, side="left"))  # lines of more than i cells
                at = first[:going] + i
                q[:going] = a[at] * q[:going] + b[at]
                p[:going] *= a[at]
                value[at], product[at] = q[:going], p[:going]
            if closed:
                with np.errstate(divide="ignore", invalid="ignore"):
                    start = q / (1 - p)
                whole = np.empty(len(t))
                for j, (f, m) in enumerate(zip(first, length)):
                    whole[f : f + m] = start[j]
                value = value + whole * product
            out = out.append_column(n, pa.array(value))
        return out

    schema = T.StructType([*grid.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return d.groupBy("_bundle").applyInArrow(run, schema)


def recurrence(grid: DataFrame, direction: Direction, a: Column, b: Column, out: str, start: Column | float = 0.0) -> DataFrame:
    """Q = a * Q_before + b along the ray, Q_before = start at the entry."""
    return recurrences(grid, direction, {out: (a, b, start if isinstance(start, Column) else F.lit(float(start)))})


def ray_length(direction: Direction, spec: GridSpec) -> float:
    return sum((d * s) ** 2 for d, s in zip(direction, spec.spacing)) ** 0.5


def _optical_step(chi: Column, direction: Direction, length: float) -> tuple[Column, Column]:
    """Optical depths from the cell before and to the cell after: geometric mean of the opacities times the length; a face's opacity goes on beyond it."""
    least = F.lit(5 * EPSILON)
    before, after = F.coalesce(incoming(chi, direction), chi), F.coalesce(outgoing(chi, direction), chi)
    return F.greatest(F.sqrt(before * chi) * length, least), F.greatest(F.sqrt(after * chi) * length, least)


def optical_depth(grid: DataFrame, direction: Direction, opacity: str, length: float, out: str) -> DataFrame:
    """Adds the sum along the ray of length * sqrt(opacity here * opacity at the cell before), the step into the first cell included."""
    g = grid.withColumn("_dm", _optical_step(F.col(opacity), direction, length)[0])
    return g.withColumn(out, F.sum("_dm").over(_window(direction).rowsBetween(Window.unboundedPreceding, 0))).drop("_dm")


#: The distance from 1 to the next number; below THIN series stand in for differences of exponentials, beyond THICK nothing is left.
EPSILON = float(np.finfo(float).eps)
THIN, THICK = 1.6 * EPSILON**0.25, -math.log(float(np.finfo(float).tiny))


def radiation(grid: DataFrame, spec: GridSpec, direction: Direction, opacity: str, source: str, out: str, start: Column | float = 0.0, depth: str = "tau") -> DataFrame:
    """Adds the intensity less the source along the ray, and the optical depth, by short characteristics of second order.

    Q = Q_before * e - S' * (1 - e) - S" * (e * (1 + dtau) - 1) with e = exp(-dtau); S' and S" are the source's first and second
    differences by optical depth at the cell. Beyond the faces opacity and source go on as at the face.
    """
    chi, s, length = F.col(opacity), F.col(source), ray_length(direction, spec)
    dm, dp = _optical_step(chi, direction, length)
    g = grid.select("*", dm.alias("_dm"), dp.alias("_dp"), F.coalesce(incoming(s, direction), s).alias("_sm"), F.coalesce(outgoing(s, direction), s).alias("_sp"))
    m, p = F.col("_dm"), F.col("_dp")
    slope_m, slope_p = (s - F.col("_sm")) / m, (F.col("_sp") - s) / p
    first, second = (slope_p * m + slope_m * p) / (m + p), 2.0 * (slope_p - slope_m) / (m + p)
    e = F.exp(-m)
    thin = m * (1 - 0.5 * m * (1 - m / 3))
    e0 = F.when(m > THICK, 0.0).when(m < THIN, 1 - thin).otherwise(e)
    e1 = F.when(m > THICK, 1.0).when(m < THIN, thin).otherwise(1 - e)
    e2 = F.when(m > THICK, -1.0).when(m < THIN, -(m * m) * (0.5 - m / 3)).otherwise(e * (1 + m) - 1)
    at = start if isinstance(start, Column) else F.lit(float(start))
    g = recurrences(g, direction, {out: (e0, -first * e1 - second * e2, at), depth: (F.lit(1.0), m, F.lit(0.0))})
    return g.drop("_dm", "_dp", "_sm", "_sp")


def extrinsic(intensity: Column, entry: Column, depth: Column) -> Column:
    """The intensity with what comes in at the entry, weakened by the optical depth from there."""
    return intensity + entry * F.exp(-depth)


def closed(grid: DataFrame, axis: int, sign: int, a: str, b: str, out: str) -> DataFrame:
    """The recurrence on a periodic axis: lines close on themselves."""
    direction = tuple(sign if k == axis else 0 for k in range(3))
    return recurrences(grid, direction, {out: (F.col(a), F.col(b), F.lit(0.0))}, closed=True)
