"""Poisson's equation and its relatives: relaxation, Krylov methods, multigrid.

Every sweep is a stencil pass; the driver holds scalars only. Sweeps are settled (written and read again) so that plans stay
small. Coarse grids with at most `SMALL` cells are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settled
from ..spec import AXES, GridSpec
from . import stencil as S
from .transfer import prolong, restrict

#: Cells of a grid that may come to the driver.
SMALL = 32_768


def _parts(s: S.Stencil) -> tuple[S.Stencil, float]:
    taps = dict(s.taps)
    centre = taps.pop((0, 0, 0), 0.0)
    return S.Stencil.of(taps), centre


def residual(grid: DataFrame, spec: GridSpec, op: S.Stencil, x: str, b: str, out: str = "r", keep: tuple[str, ...] = ()) -> DataFrame:
    g = S.apply(grid, spec, {"_ax": (op, x)}, tuple(dict.fromkeys((x, b, *keep))))
    return g.withColumn(out, F.col(b) - F.col("_ax")).drop("_ax")


def jacobi(grid: DataFrame, spec: GridSpec, op: S.Stencil, x: str, b: str, sweeps: int = 1, damping: float = 1.0) -> DataFrame:
    """x + damping * ((b - neighbours) / centre - x), sweep by sweep."""
    around, centre = _parts(op)
    for k in range(sweeps):
        g = S.apply(grid, spec, {"_n": (around, x)}, (x, b))
        new = (F.col(b) - F.col("_n")) / centre
        grid = g.select(*AXES, (F.col(x) + damping * (new - F.col(x))).alias(x), b)
        if k % 4 == 3:
            grid = settled(grid)
    return grid


def red_black(grid: DataFrame, spec: GridSpec, op: S.Stencil, x: str, b: str, sweeps: int = 1, omega: float = 1.0) -> DataFrame:
    """Successive over-relaxation: cells of even x + y + z, then the odd ones with the even ones' new values."""
    around, centre = _parts(op)
    for k in range(sweeps):
        for colour in (0, 1):
            g = S.apply(grid, spec, {"_n": (around, x)}, (x, b))
            new = (F.col(b) - F.col("_n")) / centre
            mine = (F.col("x") + F.col("y") + F.col("z")) % 2 == colour
            grid = g.select(*AXES, F.when(mine, F.col(x) + omega * (new - F.col(x))).otherwise(F.col(x)).alias(x), b)
        if k % 2:
            grid = settled(grid)
    return grid


def chebyshev_omega(rho: float, sweeps: int) -> list[float]:
    """Relaxation factors of half sweeps for a spectral radius rho of Jacobi's method."""
    out = [1.0, 1 / (1 - rho * rho / 2)]
    while len(out) < 2 * sweeps:
        out.append(1 / (1 - rho * rho * out[-1] / 4))
    return out


def _dots(g: DataFrame, **pairs: tuple[str, str]) -> dict[str, float]:
    row = g.agg(*(F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in pairs.items())).first()
    return {k: row[k] or 0.0 for k in pairs}


def cg(grid: DataFrame, spec: GridSpec, op: S.Stencil, x: str, b: str, tolerance: float = 1e-8, most: int = 200, precondition: Callable[[DataFrame], DataFrame] | None = None, relative: float = 0.0) -> tuple[DataFrame, int, float]:
    """Conjugate gradients for a symmetric definite stencil. precondition adds z to a grid that has r. Returns grid, rounds, residual norm.

    Ends at a residual norm of tolerance, or of relative times the norm of b, or after `most` rounds; the caller has to look at the norm.
    """
    pre = precondition or (lambda g: g.withColumn("z_", F.col("r")))
    g = settled(pre(residual(grid, spec, op, x, b)).withColumn("p", F.col("z_")))
    d = _dots(g, rz=("r", "z_"), rr=("r", "r"), bb=(b, b))
    tolerance, k = max(tolerance, relative * d["bb"] ** 0.5), 0
    while d["rr"] ** 0.5 > tolerance and k < most:
        g = settled(S.apply(g, spec, {"q": (op, "p")}, (x, b, "r", "z_", "p")))
        pq = _dots(g, pq=("p", "q"))["pq"]
        if not pq:
            break
        alpha = d["rz"] / pq
        g = settled(pre(g.withColumns({x: F.col(x) + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("q")}).drop("q", "z_")))
        new = _dots(g, rz=("r", "z_"), rr=("r", "r"))
        g = g.withColumn("p", F.col("z_") + (new["rz"] / d["rz"] if d["rz"] else 0.0) * F.col("p"))
        d, k = new, k + 1
    return g.select(*AXES, x, b), k, d["rr"] ** 0.5


def bicgstab(grid: DataFrame, spec: GridSpec, op: S.Stencil, x: str, b: str, tolerance: float = 1e-8, most: int = 200, relative: float = 0.0) -> tuple[DataFrame, int, float]:
    """For stencils that need not be symmetric; ends as cg does."""
    g = settled(residual(grid, spec, op, x, b).withColumns({"r0": F.col("r"), "p": F.col("r")}))
    d = _dots(g, rr=("r0", "r"), bb=(b, b))
    rho, tolerance = d["rr"], max(tolerance, relative * d["bb"] ** 0.5)
    norm, k = rho**0.5, 0
    while norm > tolerance and k < most:
        g = settled(S.apply(g, spec, {"v": (op, "p")}, (x, b, "r", "r0", "p")))
        rv = _dots(g, rv=("r0", "v"))["rv"]
        if not rv:
            break
        alpha = rho / rv
        g = settled(S.apply(g.withColumn("s", F.col("r") - alpha * F.col("v")), spec, {"t": (op, "s")}, (x, b, "r0", "p", "v", "s")))
        d = _dots(g, ts=("t", "s"), tt=("t", "t"))
        w = d["ts"] / d["tt"] if d["tt"] else 0.0
        g = g.withColumns({x: F.col(x) + alpha * F.col("p") + w * F.col("s"), "r": F.col("s") - w * F.col("t")})
        d = _dots(g, rr=("r", "r"), rho=("r0", "r"))
        norm, k = d["rr"] ** 0.5, k + 1
        if not w or not rho:
            g = settled(g)
            break
        beta, rho = d["rho"] / rho * alpha / w, d["rho"]
        g = settled(g.withColumn("p", F.col("r") + beta * (F.col("p") - w * F.col("v"))).drop("s", "t", "v"))
    return g.select(*AXES, x, b), k, norm


def solved(found: tuple[DataFrame, int, float], spec: GridSpec, op: S.Stencil, x: str, b: str, relative: float) -> DataFrame:
    """The grid of cg's or bicgstab's result; an error if b - op x, computed anew, is more than twice relative times b in norm."""
    grid, rounds, _ = found
    d = _dots(residual(grid, spec, op, x, b), rr=("r", "r"), bb=(b, b))
    if not d["rr"] ** 0.5 <= 2 * relative * d["bb"] ** 0.5:
        raise ArithmeticError(f"residual {d['rr'] ** 0.5:g} for a right side of norm {d['bb'] ** 0.5:g} after {rounds} rounds")
    return grid


def direct(grid: DataFrame, spec: GridSpec, op: S.Stencil, x: str, b: str) -> DataFrame:
    """A small periodic grid, solved on the driver in wave space; the answer has mean 0 if the stencil has no constant part."""
    if spec.cells > SMALL:
        raise ValueError(f"{spec.cells} cells are too many for the driver")
    rows = grid.select(*AXES, b).toPandas()  # SMALL cells at most
    a = np.zeros(spec.n)
    a[rows.x, rows.y, rows.z] = rows[b]
    kernel = np.zeros(spec.n)
    for t, c in op.taps:
        kernel[tuple(-k % n for k, n in zip(t, spec.n))] += c
    symbol = np.fft.fftn(kernel)
    flat = np.abs(symbol) < 1e-12 * np.abs(symbol).max()
    sol = np.real(np.fft.ifftn(np.where(flat, 0, np.fft.fftn(a) / np.where(flat, 1, symbol))))
    keys = np.indices(spec.n).reshape(3, -1).astype(np.int32)
    import pandas as pd

    out = pd.DataFrame({k: v for k, v in zip(AXES, keys)} | {x: sol.ravel(), b: a.ravel()})
    return grid.sparkSession.createDataFrame(out, f"x int, y int, z int, `{x}` double, `{b}` double")


def v_cycle(grid: DataFrame, spec: GridSpec, x: str, b: str, before: int = 2, after: int = 2, coarsest: int = SMALL, scale: float = 1.0) -> DataFrame:
    """One V-cycle for the seven-point Laplacian on a periodic grid of even sizes, damped Jacobi for smoothing."""
    op = S.laplace(2).scaled(scale)
    if spec.cells <= coarsest or any(n % 2 or n < 4 for n in spec.n if n > 1):
        return direct(grid, spec, op, x, b)
    g = jacobi(grid, spec, op, x, b, before, 6 / 7)
    r = restrict(residual(g, spec, op, x, b), spec, ("r",))
    below = GridSpec(tuple(max(1, n // 2) for n in spec.n), periodic=spec.periodic)
    r = settled(r.select(*AXES, F.lit(0.0).alias("e"), "r"))
    e = v_cycle(r, below, "e", "r", before, after, coarsest, scale / 4)
    g = g.join(prolong(e, spec, ("e",)), list(AXES)).select(*AXES, (F.col(x) + F.col("e")).alias(x), b)
    return settled(jacobi(settled(g), spec, op, x, b, after, 6 / 7))


def refine(grid: DataFrame, spec: GridSpec, op: S.Stencil, x: str, b: str, solve: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """Iterative refinement: solve for the residual in single precision, correct in double."""
    for _ in range(rounds):
        r = residual(grid, spec, op, x, b).select(*AXES, x, b, F.col("r").cast("float").cast("double").alias("r"), F.lit(0.0).alias("e"))
        e = solve(settled(r.select(*AXES, "e", "r"))).select(*AXES, F.col("e").cast("float").cast("double").alias("e"))
        grid = settled(grid.select(*AXES, x, b).join(e, list(AXES)).select(*AXES, (F.col(x) + F.col("e")).alias(x), b))
    return grid
