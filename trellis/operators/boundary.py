"""Boundary conditions: rows for the cells beyond a face, so that stencils reach across it.

A ghost cell at depth d beyond a face takes its value from its own line: `mirror` is the cell d inside the face, `edge` the
face's cell. Conditions apply axis after axis, to rows that earlier axes have added too, which settles edges and corners.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import AXES, GridSpec


@dataclass(frozen=True)
class Condition:
    """kind: periodic, symmetric, antisymmetric, relative (about the edge's value), constant, derivative, outflow, inflow, one_sided, fixed."""

    kind: str
    value: float = 0.0


KINDS = ("periodic", "symmetric", "antisymmetric", "relative", "constant", "derivative", "outflow", "inflow", "one_sided", "fixed")
#: Weights of the seven cells inside that continue a line by a vanishing seventh difference, nearest first.
_CONTINUED = (7.0, -21.0, 35.0, -35.0, 21.0, -7.0, 1.0)


def _continuation(depth: int) -> list[list[float]]:
    """For each depth, the weights of the seven cells nearest the face: the rule applied again to what it has given."""
    known = [[1.0 if i == k else 0.0 for i in range(7)] for k in range(6, -1, -1)]  # from the seventh inside up to the edge
    for _ in range(depth):
        known.append([sum(w * known[-1 - k][i] for k, w in enumerate(_CONTINUED)) for i in range(7)])
    return known[7:]


def extend(grid: DataFrame, spec: GridSpec, fields: Mapping[str, Condition], axis: int, depth: int, sides: tuple[int, ...] = (-1, 1)) -> DataFrame:
    """grid and `depth` layers beyond both faces of the axis; every field has its condition there."""
    name, n, names = AXES[axis], spec.n[axis], list(fields)
    if not spec.active(axis):
        return grid
    need = max(depth + 1, 7 if any(c.kind == "one_sided" for c in fields.values()) else 0)
    if need > n:
        raise ValueError(f"axis {name} has {n} cells; depth {depth} reads {need}")
    if any(c.kind not in KINDS for c in fields.values()):
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    others = [a for a in AXES if a != name]
    parts = [grid.select(*AXES, *names)]
    for side in sides:
        edge = 0 if side < 0 else n - 1
        inside = lambda k, e=edge, s=side: e - s * k
        band = grid.where(F.col(name).between(min(inside(0), inside(need - 1)), max(inside(0), inside(need - 1))))
        wraps = [f for f, c in fields.items() if c.kind == "periodic"]
        near = {f: {k: F.max(F.when(F.col(name) == inside(k), F.col(f))) for k in range(need)} for f in names if f not in wraps}
        line = band.groupBy(*others).agg(*(v.alias(f"_{f}_{k}") for f, by in near.items() for k, v in by.items()), F.count(F.lit(1)).alias("_rows"))
        if wraps:
            far = grid.where(F.col(name).between(*((n - depth, n - 1) if side < 0 else (0, depth - 1))))
            there = lambda d, s=side: n - d if s < 0 else d - 1
            line = line.join(far.groupBy(*others).agg(*(F.max(F.when(F.col(name) == there(d), F.col(f))).alias(f"_{f}_w{d}") for f in wraps for d in range(1, depth + 1))), others)
        cells = F.explode(F.array(*(F.struct(F.lit(edge + side * d).alias(name), *(_ghost(fields[f], f, d, side, spec.spacing[axis], depth).alias(f) for f in names)) for d in range(1, depth + 1))))
        ghost = line.select(*others, cells.alias("_g")).select(*others, "_g.*")
        parts.append(ghost.select(*AXES, *names))
    out = parts[0]
    zero = [f for f, c in fields.items() if c.kind == "antisymmetric"]
    if zero:  # the face itself is the zero of an odd function
        faces = F.col(name).isin(*([0] * (-1 in sides) + [n - 1] * (1 in sides)))
        out = out.withColumns({f: F.when(faces, 0.0).otherwise(F.col(f)) for f in zero})
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ghost(c: Condition, f: str, d: int, side: int, spacing: float, depth: int) -> Column:
    mirror, edge = F.col(f"_{f}_{d}") if c.kind != "periodic" else None, F.col(f"_{f}_0") if c.kind != "periodic" else None
    if c.kind == "periodic":
        return F.col(f"_{f}_w{d}")
    if c.kind == "symmetric":
        return mirror
    if c.kind == "antisymmetric":
        return -mirror
    if c.kind == "relative":
        return 2 * edge - mirror
    if c.kind == "constant":
        return F.lit(float(c.value))
    if c.kind == "derivative":
        return mirror + 2 * d * side * spacing * c.value
    if c.kind in ("outflow", "inflow"):
        out = edge * side > 0
        return F.when(out if c.kind == "outflow" else ~out, mirror).otherwise(-mirror)
    if c.kind == "one_sided":
        w = _continuation(depth)[d - 1]
        return sum((F.col(f"_{f}_{k}") * x for k, x in enumerate(w) if x), F.lit(0.0))
    return F.lit(None).cast("double")  # fixed: no value is made up


def surround(grid: DataFrame, spec: GridSpec, fields: Mapping[str, Mapping[int, Condition] | Condition], depth: int) -> DataFrame:
    """All axes, x then y then z. A field's condition is one for all axes, or one for each axis."""
    for axis in range(3):
        one = {f: (c if isinstance(c, Condition) else c[axis]) for f, c in fields.items()}
        grid = extend(grid, spec, one, axis, depth)
    return grid


def shear_shift(grid: DataFrame, spec: GridSpec, field: str, shift: float, depth: int) -> DataFrame:
    """Ghosts beyond the x faces of a shearing box: periodic in x, with y + shift read below and y - shift above, between cells by 6 points."""
    from fractions import Fraction

    from .stencil import weights

    nx, ny = spec.n[0], spec.n[1]
    parts = [grid.select(*AXES, field)]
    for side in (-1, 1):
        move = -side * shift
        whole = int(move // 1)
        offsets = tuple(Fraction(k) - Fraction(move - whole).limit_denominator(10**6) for k in range(-2, 4))
        w = weights(0, offsets)
        band = grid.where(F.col("x") >= nx - depth if side < 0 else F.col("x") < depth).withColumn("x", F.col("x") + side * nx)
        taps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(c)).alias("c")) for k, c in zip(range(-2, 4), w))))
        sent = band.select("x", "y", "z", field, taps.alias("_t")).withColumn("y", F.pmod(F.col("y") - F.col("_t.k") - whole, F.lit(ny)).cast("int"))
        parts.append(sent.groupBy(*AXES).agg(F.sum(F.col(field) * F.col("_t.c")).alias(field)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
