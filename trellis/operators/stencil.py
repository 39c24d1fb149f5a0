"""Stencils: a table of taps {(dx, dy, dz): coefficient} reduced by sum, maximum or sum of exponentials around each cell.

A tap counts if there is a row at its place and the field isn't null there; NaN is a value like others and goes on. A cell is in
the result if some tap of the pass finds a row; a stencil none of whose taps counts is null there. Two strategies give the
same:

* blocks: cells are dealt to boxes, boundary layers are sent to the neighbouring boxes as well, and each box is computed
  with numpy slices. Rows move once, plus the layers, however many taps there are.
* scatter: each cell sends its fields to the cells that read it, one aggregation brings them together. Pure Catalyst, but every
  tap is a row of the shuffle, so it is for stencils of seven taps at most, which it does in half the time on small grids.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import AXES, GridSpec

Tap = tuple[int, int, int]
#: Taps beyond which boxes are used; both strategies give the same.
MANY = 7
OPS = ("sum", "max", "expsum")


@dataclass(frozen=True)
class Stencil:
    taps: tuple[tuple[Tap, float], ...]
    op: str = "sum"

    @classmethod
    def of(cls, taps: Mapping[Tap, float], op: str = "sum") -> Stencil:
        if op not in OPS:
            raise ValueError(f"op is one of {', '.join(OPS)}")
        return cls(tuple(sorted((tuple(k), float(v)) for k, v in taps.items() if v or op == "max")), op)

    @property
    def radius(self) -> tuple[int, int, int]:
        return tuple(max((abs(t[a]) for t, _ in self.taps), default=0) for a in range(3))

    def scaled(self, by: float) -> Stencil:
        return Stencil.of({t: c * by for t, c in self.taps}, self.op)

    def __add__(self, other: Stencil) -> Stencil:
        out = dict(self.taps)
        for t, c in other.taps:
            out[t] = out.get(t, 0.0) + c
        return Stencil.of(out, self.op)

    def then(self, other: Stencil) -> Stencil:
        """The one pass that equals this after other."""
        out: dict[Tap, float] = {}
        for (a, c), (b, d) in product(self.taps, other.taps):
            t = tuple(i + j for i, j in zip(a, b))
            out[t] = out.get(t, 0.0) + c * d
        return Stencil.of(out)

    def numpy(self, a: np.ndarray, axes: tuple[int, int, int] = (0, 1, 2)) -> np.ndarray:
        """On an array with periodic edges."""
        parts = [c * np.roll(a, tuple(-d for d in t), axes) for t, c in self.taps]
        if self.op == "expsum":
            parts = [c * np.roll(np.exp(a), tuple(-d for d in t), axes) for t, c in self.taps]
        return np.maximum.reduce(parts) if self.op == "max" else sum(parts)


@cache
def weights(order: int, offsets: tuple[Fraction | int, ...]) -> tuple[Fraction, ...]:
    """Weights of values at the offsets that give the derivative at 0 exactly for polynomials of degree below their number."""
    n = len(offsets)
    rows = [[Fraction(o) ** k for o in offsets] + [Fraction(0)] for k in range(n)]
    f = Fraction(1)
    for k in range(2, order + 1):
        f *= k
    rows[order][n] = f
    for i in range(n):
        p = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[p] = rows[p], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [a - rows[r][i] * b for a, b in zip(rows[r], rows[i])]
    return tuple(r[n] for r in rows)


def _on(axis: int, offset: int) -> Tap:
    return tuple(offset if k == axis else 0 for k in range(3))


def central(axis: int, order: int = 1, accuracy: int = 6, spacing: float = 1.0) -> Stencil:
    """Central difference. accuracy 2, 4, 6 or 8 sets the radius to half of it, at least what the order needs."""
    r = max(accuracy // 2, (order + 1) // 2)
    offsets = tuple(range(-r, r + 1))
    return Stencil.of({_on(axis, o): float(w) / spacing**order for o, w in zip(offsets, weights(order, offsets))})


def one_sided(axis: int, side: int, order: int = 1, points: int = 7, spacing: float = 1.0) -> Stencil:
    """Difference from the cell to `points` cells on one side (+1 or -1), the cell included."""
    offsets = tuple(side * k for k in range(points))
    return Stencil.of({_on(axis, o): float(w) / spacing**order for o, w in zip(offsets, weights(order, offsets))})


def upwind(axis: int, side: int, accuracy: int = 5, spacing: float = 1.0) -> Stencil:
    """First derivative with one point more on the upwind side: side -1 for flow in the positive direction."""
    r = (accuracy + 1) // 2
    offsets = tuple(range(-r, r)) if side < 0 else tuple(range(-r + 1, r + 1))
    return Stencil.of({_on(axis, o): float(w) / spacing for o, w in zip(offsets, weights(1, offsets))})


def upwind_dissipation(axis: int, spacing: float = 1.0) -> Stencil:
    """Sixth difference over 60 spacings, which |velocity| times gives fifth-order upwinding."""
    return central(axis, 6, 6).scaled(1 / (60 * spacing))


def mixed(a: int, b: int, accuracy: int = 6, spacing: tuple[float, float] = (1.0, 1.0)) -> Stencil:
    """d2/dadb along the two diagonals: a quarter of the second-derivative weights, signs by quadrant."""
    r = accuracy // 2
    offsets = tuple(range(-r, r + 1))
    out = {}
    for k, w in zip(offsets, weights(2, offsets)):
        for s in (1, -1):
            if k > 0:
                for i, j in ((k, s * k), (-k, -s * k)):
                    out[tuple((i if q == a else 0) + (j if q == b else 0) for q in range(3))] = s * float(w) / 4 / (spacing[0] * spacing[1])
    return Stencil.of(out)


def crossed(orders: Tap, accuracy: int = 6, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Stencil:
    """Products of central differences, as in d6/dx4dy2."""
    out = Stencil.of({(0, 0, 0): 1.0})
    for axis, order in enumerate(orders):
        if order:
            out = out.then(central(axis, order, accuracy, spacing[axis]))
    return out


def laplace(accuracy: int = 6, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), axes: tuple[int, ...] = (0, 1, 2)) -> Stencil:
    out = Stencil.of({})
    for a in axes:
        out = out + central(a, 2, accuracy, spacing[a])
    return out


def box(radius: int, weight=None, op: str = "sum", axes: tuple[int, ...] = (0, 1, 2)) -> Stencil:
    """All neighbours within the radius along each axis; weight(dx, dy, dz), normalised to a sum of 1 unless op is max."""
    ranges = [range(-radius, radius + 1) if a in axes else (0,) for a in range(3)]
    taps = {t: (weight(*t) if weight else 1.0) for t in product(*ranges)}
    total = sum(taps.values()) if op == "sum" else 1.0
    return Stencil.of({t: w / total for t, w in taps.items()}, op)


def average(radius: int = 1) -> Stencil:
    return box(radius)


def binomial(radius: int = 1, axes: tuple[int, ...] = (0, 1, 2)) -> Stencil:
    """1-2-1 and its powers along each axis."""
    from math import comb

    return box(radius, lambda *t: np.prod([comb(2 * radius, radius + t[a]) for a in axes]), axes=axes)


def gaussian(radius: int = 3, sigma: float | None = None) -> Stencil:
    """Gaussian weights over the box, normalised; the variance is radius - 1, so 2 at radius 3 and 4 at radius 5."""
    variance = sigma * sigma if sigma else max(radius - 1, 0.5)
    return box(radius, lambda *t: float(np.exp(-sum(k * k for k in t) / (2 * variance))))


# Weights along each axis of the smoothing that shock viscosity uses, by accuracy.
SMOOTH = {2: (9, 14, 9), 6: (1, 9, 45, 70, 45, 9, 1)}


def smooth(accuracy: int = 6, axes: tuple[int, ...] = (0, 1, 2)) -> Stencil:
    w = SMOOTH[2 if accuracy == 2 else 6]
    r = len(w) // 2
    return box(r, lambda *t: float(np.prod([w[r + t[a]] for a in axes])), axes=axes)


def ball(radius: int, op: str = "max") -> Stencil:
    """All neighbours whose distance is at most the radius."""
    s = box(radius, op="max")
    taps = {t: 1.0 for t, _ in s.taps if sum(k * k for k in t) <= radius * radius}
    return Stencil.of(taps if op == "max" else {t: 1 / len(taps) for t in taps}, op)


def local_max(radius: int = 1) -> Stencil:
    return box(radius, op="max")


def midpoint(axis: int, side: int) -> Stencil:
    return Stencil.of({(0, 0, 0): 0.5, _on(axis, side): 0.5})


def mehrstellen(accuracy: int = 4) -> tuple[Stencil, Stencil]:
    """Compact Poisson pair (left, right) on unit spacing: left(u) = right(f). accuracy 2: the 7-point pair; 4: 19 points.

    6: 27 points, and second neighbours of the right side up to the biharmonic of f.
    """
    def by_distance(*w):
        return {t: float(w[sum(map(abs, t))]) for t in product((-1, 0, 1), repeat=3) if sum(map(abs, t)) < len(w)}

    if accuracy == 2:
        return laplace(2), Stencil.of({(0, 0, 0): 1.0})
    if accuracy == 4:
        left = by_distance(Fraction(-24, 6), Fraction(2, 6), Fraction(1, 6))
        return Stencil.of(left), Stencil.of(by_distance(Fraction(1, 2), Fraction(1, 12)))
    left = by_distance(Fraction(-128, 30), Fraction(14, 30), Fraction(3, 30), Fraction(1, 30))
    one = Stencil.of({(0, 0, 0): 1.0})
    flat, cross = laplace(2), crossed((2, 2, 0), 2) + crossed((2, 0, 2), 2) + crossed((0, 2, 2), 2)
    fourth = central(0, 4, 2) + central(1, 4, 2) + central(2, 4, 2)
    wide = flat + fourth.scaled(-1 / 12)
    right = one + wide.scaled(1 / 12) + fourth.scaled(1 / 360) + cross.scaled(1 / 90)
    return Stencil.of(left), right


def apply(grid: DataFrame, spec: GridSpec, stencils: Mapping[str, tuple[Stencil, str]], keep: tuple[str, ...] = (), strategy: str | None = None) -> DataFrame:
    """grid's keys and `keep`, and a column for each name: stencil of field. Axes wrap where spec is periodic.

    Beyond a face that isn't periodic there are no values: extend the grid with trellis.operators.boundary first, and the
    result has the cells that the spec has. Along an axis of size 1 only taps that stay in the plane count.
    """
    every = {t for s, _ in stencils.values() for t, _ in s.taps} | ({(0, 0, 0)} if keep else set())
    if strategy is None:
        strategy = "blocks" if len(every) > MANY else "scatter"
    return (_scatter if strategy == "scatter" else _blocks)(grid, spec, stencils, keep)


def _wrapped(spec: GridSpec, axis: int, c: Column) -> Column:
    return F.pmod(c, F.lit(spec.n[axis])).cast("int") if spec.periodic[axis] and spec.active(axis) else c.cast("int")


def _inside(spec, stencils):
    """The stencils with the taps that stay in the plane of an axis of size 1."""
    return {name: (Stencil(tuple((t, c) for t, c in s.taps if all(spec.active(a) or not t[a] for a in range(3))), s.op), f) for name, (s, f) in stencils.items()}


def _scatter(grid, spec, stencils, keep):
    stencils = _inside(spec, stencils)
    taps = sorted({t for s, _ in stencils.values() for t, _ in s.taps} | ({(0, 0, 0)} if keep or not stencils else set()))
    fields = sorted({f for _, f in stencils.values()} | set(keep))
    tap = F.array(*(F.struct(F.lit(t[0]).alias("dx"), F.lit(t[1]).alias("dy"), F.lit(t[2]).alias("dz"), F.lit(i + 1).alias("tap")) for i, t in enumerate(taps)))
    sent = grid.select(*AXES, *fields, F.explode(tap).alias("_t"))
    to = [_wrapped(spec, k, F.col(a) - F.col(f"_t.d{a}")).alias(a) for k, a in enumerate(AXES)]
    sent = sent.select(*to, *fields, F.col("_t.tap").alias("_tap")).where(spec.inside())
    aggs = []
    for name, (s, f) in stencils.items():
        at = dict(s.taps)  # no coefficient, no part in it: nothing times NaN would be NaN
        c = F.element_at(F.array(*(F.lit(at[t]) if t in at else F.lit(None).cast("double") for t in taps)), F.col("_tap"))
        v = F.col(f).cast("double")
        aggs.append((F.max(c * v) if s.op == "max" else F.sum(c * (F.exp(v) if s.op == "expsum" else v))).alias(name))
    if keep:
        centre = taps.index((0, 0, 0)) + 1
        aggs += [F.first(F.when(F.col("_tap") == centre, F.col(k)), ignorenulls=True).alias(k) for k in keep if k not in stencils]
    return sent.groupBy(*AXES).agg(*aggs)


def _boxes(at: Column, n: int, reach: int, side: int) -> Column:
    """Boxes along an axis that hold the place, or have it in their layers, with the place."""
    lo = F.greatest(F.floor((at - reach) / side), F.lit(0)).cast("int")
    hi = F.least(F.floor((at + reach) / side), F.lit(-(-n // side) - 1)).cast("int")
    near = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    near = F.filter(near, lambda b: (at >= b * side - reach) & (at < F.least(b * side + side, F.lit(n)) + reach))
    return F.transform(near, lambda b: F.struct(b.alias("b"), at.cast("int").alias("at")))


def _blocks(grid, spec, stencils, keep, side: int = 32):
    kept = [k for k in keep if k not in stencils]
    fields = sorted({f for _, f in stencils.values()} | set(kept))
    reach = [max((s.radius[a] for s, _ in stencils.values()), default=0) if spec.active(a) else 0 for a in range(3)]
    stencils = _inside(spec, stencils)
    every = sorted({t for s, _ in stencils.values() for t, _ in s.taps} | ({(0, 0, 0)} if keep or not stencils else set()))
    read = sorted({f for _, f in stencils.values()})
    d = grid.select(*AXES, *fields)
    for a, name in enumerate(AXES):  # to each box that has the cell, or has it in its layers
        n, r, per = spec.n[a], reach[a], spec.periodic[a] and spec.active(a)
        options = []
        for shift in (0, n, -n) if per and r else (0,):
            at = F.col(name) + F.lit(shift)
            options.append(_boxes(at, n, r, side))
        d = d.withColumn("_o", F.explode(F.concat(*options))).withColumn(name, F.col("_o.at")).withColumn(f"_b{name}", F.col("_o.b")).drop("_o")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        box_ = [t.column(f"_b{a}")[0].as_py() for a in AXES]
        start = [b * side for b in box_]
        size = [min(side, n - s) for s, n in zip(start, spec.n)]
        at = tuple(t.column(a).to_numpy() - s + r for a, s, r in zip(AXES, start, reach))
        inner = tuple(slice(r, r + k) for r, k in zip(reach, size))
        shape = [k + 2 * r for k, r in zip(size, reach)]
        place = np.full(shape, -1, np.int64)
        place[at] = np.arange(len(t))
        there = place >= 0
        data, known = {}, {}
        for f in read:
            column = t.column(f).cast(pa.float64())
            data[f], known[f] = np.zeros(shape), np.zeros(shape, bool)
            known[f][at] = column.is_valid().to_numpy()
            data[f][at] = column.fill_null(0.0).to_numpy()
        moved = lambda array, tap: array[tuple(slice(i.start + o, i.stop + o) for i, o in zip(inner, tap))]
        reached = np.zeros(size, bool)
        for tap in every:
            reached |= moved(there, tap)
        out = {}
        for name, (s, f) in stencils.items():
            values = np.exp(data[f]) if s.op == "expsum" else data[f]
            total, seen, full = np.zeros(size), np.zeros(size, bool), bool(known[f].all())
            for tap, c in s.taps:
                part, has = c * moved(values, tap), moved(known[f], tap)
                if s.op == "max":
                    larger = np.where(seen, np.maximum(total, part), part)
                    total = larger if full else np.where(has, larger, total)
                else:
                    total += part if full else np.where(has, part, 0.0)
                seen |= has
            out[name] = pa.array(total[reached], mask=~seen[reached])
        centre = place[inner][reached]
        for k in kept:
            out[k] = t.column(k).take(pa.array(centre, mask=centre < 0))
        keys = np.indices(size).reshape(3, -1)[:, reached.ravel()]
        cols = {a: pa.array((k + s).astype(np.int32)) for a, k, s in zip(AXES, keys, start)}
        return pa.table(cols | {k: out[k] for k in names})

    names = [*stencils, *kept]
    kinds = {f.name: f.dataType for f in grid.schema.fields}
    schema = T.StructType([T.StructField(a, T.IntegerType()) for a in AXES] + [T.StructField(k, T.DoubleType() if k in stencils else kinds[k]) for k in names])
    return d.groupBy("_bx", "_by", "_bz").applyInArrow(run, schema)


def stencil_sql(source: str, spec: GridSpec, s: Stencil, field: str, out: str) -> str:
    """The same as apply() with one stencil on periodic axes, as SQL."""
    rows = ", ".join(f"({t[0]}, {t[1]}, {t[2]}, CAST({c!r} AS DOUBLE))" for t, c in s.taps)
    to = ", ".join(f"CAST((({a} - d{a}) % {n} + {n}) % {n} AS INTEGER) AS {a}" for a, n in zip(AXES, spec.n))
    return f"SELECT x, y, z, {s.op}(v) AS {out} FROM (SELECT {to}, c * {field} AS v FROM {source}, (VALUES {rows}) AS taps(dx, dy, dz, c)) GROUP BY x, y, z"
