"""Time stepping: Runge-Kutta schemes, time step limits, forcing, initial conditions, equations of motion."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import replaced, settled
from ..spec import AXES, GridSpec
from . import calculus as C

#: Right-hand side: (grid, time) to the grid with a column `d_<field>` for each field.
Rhs = Callable[[DataFrame, float], DataFrame]

# Low-storage Runge-Kutta schemes. w = alpha * w + dt * rhs, f = f + beta * w, stage by stage.
LOW_STORAGE = {
    1: ((0.0,), (1.0,)),
    2: ((0.0, -1 / 2), (1 / 2, 1.0)),
    3: ((0.0, -5 / 9, -153 / 128), (1 / 3, 15 / 16, 8 / 15)),
}
# Five-stage low-storage scheme of fourth order, its third-order weights for the error, and the stages' own coefficients.
RKF4_BETA = (1153189308089 / 22510343858157, 1772645290293 / 4653164025191, -1672844663538 / 4480602732383, 2114624349019 / 3568978502595, 5198255086312 / 14908931495163)
RKF4_BETA_HAT = (1016888040809 / 7410784769900, 11231460423587 / 58533540763752, -1563879915014 / 6823010717585, 606302364029 / 971179775848, 1097981568119 / 3980877426909)
RKF4_ALPHA = (970286171893 / 4311952581923, 6584761158862 / 12103376702013, 2251764453980 / 15575788980749, 26877169314380 / 34165994151039, 0.0)


def _with_rates(g: DataFrame, fields: tuple[str, ...], carried: dict[str, str], rhs: Rhs, t: float) -> DataFrame:
    """g with d_<field>; a right-hand side that gives back its input's other columns spares the join with them."""
    d = rhs(g, t)
    rates = [f"d_{f}" for f in fields]
    if set(carried) <= set(d.columns):
        return d.select(*AXES, *carried, *rates)
    return g.select(*AXES, *carried).join(d.select(*AXES, *rates), list(AXES))


def step(grid: DataFrame, fields: tuple[str, ...], rhs: Rhs, t: float, dt: float, order: int = 3) -> DataFrame:
    """One low-storage step. Settled once for each stage."""
    alphas, betas = LOW_STORAGE[order]
    carried = dict.fromkeys((*fields, *(f"w_{f}" for f in fields)), "")
    g = grid.select(*AXES, *fields, *(F.lit(0.0).alias(f"w_{f}") for f in fields))
    at = [0.0]
    for k in range(len(betas) - 1):  # the stages' times: a step of size c with f' = 1
        w = 0.0
        f = 0.0
        for a, b in list(zip(alphas, betas))[: k + 1]:
            w = a * w + 1
            f += b * w
        at.append(f)
    last = None
    for a, b, c in zip(alphas, betas, at):
        g = _with_rates(g, fields, carried, rhs, t + c * dt)
        w = {f: F.lit(a) * F.col(f"w_{f}") + F.lit(dt) * F.col(f"d_{f}") for f in fields}
        g = settled(g.select(*AXES, *((F.col(f) + F.lit(b) * w[f]).alias(f) for f in fields), *(w[f].alias(f"w_{f}") for f in fields)))
        last = replaced(last, g)
    return g.select(*AXES, *fields)


def rkf4(grid: DataFrame, fields: tuple[str, ...], rhs: Rhs, t: float, dt: float) -> tuple[DataFrame, float]:
    """One step of fourth order in five stages with three registers, and the largest difference from third order.

    A stage's rate goes into the sum with its beta, and, with its alpha, on the sum as it was before, into the next stage's argument.
    """
    sums, errors = [f"s_{f}" for f in fields], [f"e_{f}" for f in fields]
    carried = dict.fromkeys((*fields, *sums, *errors), "")
    g = grid.select(*AXES, *fields, *(F.col(f).alias(f"s_{f}") for f in fields), *(F.lit(0.0).alias(e) for e in errors))
    last = None
    for k, (alpha, beta, hat) in enumerate(zip(RKF4_ALPHA, RKF4_BETA, RKF4_BETA_HAT)):
        at = sum(RKF4_BETA[: k - 1]) + RKF4_ALPHA[k - 1] if k else 0.0
        g = _with_rates(g, fields, carried, rhs, t + at * dt)
        rate = {f: F.lit(dt) * F.col(f"d_{f}") for f in fields}
        g = settled(g.select(
            *AXES, *((F.col(f"s_{f}") + F.lit(alpha) * rate[f]).alias(f) for f in fields),
            *((F.col(f"s_{f}") + F.lit(beta) * rate[f]).alias(f"s_{f}") for f in fields), *((F.col(f"e_{f}") + F.lit(beta - hat) * rate[f]).alias(f"e_{f}") for f in fields)))
        last = replaced(last, g)
    error = g.agg(*(F.max(F.abs(e)).alias(e) for e in errors)).first()
    return g.select(*AXES, *(F.col(f"s_{f}").alias(f) for f in fields)), max((x for x in error if x is not None), default=0.0)


def run(grid: DataFrame, fields: tuple[str, ...], rhs: Rhs, steps: int, dt: float | Callable[[DataFrame], float], order: int = 3, t: float = 0.0, every: Mapping[int, Callable[[int, float, DataFrame], None]] | None = None) -> tuple[DataFrame, float]:
    """The loop: a step, then what is due every so many steps (diagnostics, slices, snapshots)."""
    for k in range(1, steps + 1):
        size = dt(grid) if callable(dt) else dt
        grid, t = step(grid, fields, rhs, t, size, order), t + size
        for n, act in (every or {}).items():
            if k % n == 0:
                act(k, t, grid)
    return grid, t


def diagnostics(grid: DataFrame, spec: GridSpec, fields: tuple[str, ...], k: int, t: float) -> DataFrame:
    """A row: step, time, and minimum, rms and maximum of each field."""
    aggs = [F.lit(k).alias("step"), F.lit(t).alias("t")]
    for f in fields:
        aggs += [F.min(f).alias(f"{f}_min"), F.sqrt(F.sum(F.col(f) ** 2) / spec.cells).alias(f"{f}_rms"), F.max(f).alias(f"{f}_max")]
    return grid.agg(*aggs)


def time_step(grid: DataFrame, spec: GridSpec, u: tuple[str, str, str], sound: Column | float = 0.0, viscosity: float = 0.0, hyper: float = 0.0, courant: float = 0.4, diffusive: float = 0.3) -> float:
    """The least of the advective, diffusive and hyper-diffusive limits."""
    d = min(s for a, s in enumerate(spec.spacing) if spec.active(a))
    c = F.lit(float(sound)) if isinstance(sound, (int, float)) else sound
    fastest = grid.agg(F.max(F.sqrt(F.col(u[0]) ** 2 + F.col(u[1]) ** 2 + F.col(u[2]) ** 2) + c)).first()[0] or 0.0
    limits = [courant * d / fastest] if fastest else []
    limits += [diffusive * d * d / viscosity] if viscosity else []
    limits += [diffusive * d**6 / hyper] if hyper else []
    return min(limits, default=math.inf)


@dataclass(frozen=True)
class Helical:
    """A forcing wave: wave vector k, phase, amplitude, helicity from -1 to 1; e is any vector not along k."""

    k: tuple[float, float, float]
    phase: float = 0.0
    amplitude: float = 1.0
    helicity: float = 1.0
    e: tuple[float, float, float] = (0.3, 0.5, 0.8)

    def columns(self, spec: GridSpec) -> list[Column]:
        k, s = self.k, self.helicity
        size = math.sqrt(sum(x * x for x in k))
        cross = lambda a, b: tuple(a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3))
        ke = cross(k, self.e)
        kke = cross(k, ke)
        norm = math.sqrt(1 + s * s) * size * math.sqrt(sum(x * x for x in ke))
        if not norm:
            raise ValueError("e is along k")
        where = sum((F.lit(float(k[a])) * spec.position(a) for a in range(3)), F.lit(float(self.phase)))
        return [F.lit(self.amplitude) * (F.lit(-s * kke[i] / norm) * F.cos(where) + F.lit(-size * ke[i] / norm) * F.sin(where)) for i in range(3)]


def uniform_random(seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """The same for a cell whatever the partitions are."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *AXES), 11).cast("double") / float(1 << 53)
    return F.lit(low) + u * F.lit(high - low)


def normal_random(seed: int) -> Column:
    """By Box and Muller."""
    return F.sqrt(-2 * F.log(1 - uniform_random(seed))) * F.cos(2 * math.pi * uniform_random(seed + 1))


def initial(spec: GridSpec, kind: str, seed: int = 0, amplitude: float = 1.0) -> dict[str, Column]:
    """Initial conditions by name, as columns of the keys."""
    x = [spec.position(a) for a in range(3)]
    c = spec.center()
    r = F.sqrt(sum(((p - F.lit(q)) ** 2 for p, q in zip(x, c)), F.lit(0.0)))
    wave = [2 * math.pi / (s * n) if n > 1 else 0.0 for s, n in zip(spec.spacing, spec.n)]
    a = F.lit(float(amplitude))
    if kind == "zero":
        return {"f": F.lit(0.0)}
    if kind == "constant":
        return {"f": a}
    if kind == "random":
        return {"f": uniform_random(seed, -amplitude, amplitude)}
    if kind == "gaussian":
        return {"f": a * F.exp(-(r * r) / 2)}
    if kind == "sine":
        return {"f": a * F.sin(x[0] * wave[0])}
    if kind == "radial":
        return {"ux": a * (x[0] - c[0]) / F.greatest(r, F.lit(1e-12)), "uy": a * (x[1] - c[1]) / F.greatest(r, F.lit(1e-12)), "uz": a * (x[2] - c[2]) / F.greatest(r, F.lit(1e-12))}
    if kind == "beltrami":
        return {"ux": a * F.cos(x[2] * wave[2]), "uy": a * F.sin(x[2] * wave[2]), "uz": F.lit(0.0)}
    if kind == "abc":
        s, o = [F.sin(p * w) for p, w in zip(x, wave)], [F.cos(p * w) for p, w in zip(x, wave)]
        return {"ux": a * (s[2] + o[1]), "uy": a * (s[0] + o[2]), "uz": a * (s[1] + o[0])}
    if kind == "vortex":
        return {"ux": -a * (x[1] - c[1]) * F.exp(-(r * r) / 2), "uy": a * (x[0] - c[0]) * F.exp(-(r * r) / 2), "uz": F.lit(0.0)}
    if kind == "shell":
        return {"f": F.when(r < amplitude, 1.0).otherwise(0.0)}
    raise ValueError(f"no initial condition {kind!r}")


@dataclass(frozen=True)
class Fluid:
    """Isothermal or ideal magnetohydrodynamics in log density, velocity, entropy and vector potential."""

    viscosity: float = 5e-3
    resistivity: float = 5e-3
    sound: float = 1.0
    gamma: float = 5 / 3
    cp: float = 1.0
    conductivity: float = 1e-3
    magnetic: bool = True
    entropy: bool = True
    forcing: Helical | None = None
    bulk: float = 0.0

    @property
    def fields(self) -> tuple[str, ...]:
        return ("lnrho", "ux", "uy", "uz", *(("ss",) if self.entropy else ()), *(("ax", "ay", "az") if self.magnetic else ()))

    def rhs(self, spec: GridSpec) -> Rhs:
        u, a = ("ux", "uy", "uz"), ("ax", "ay", "az")

        def build(d: C.Derivatives) -> dict[str, Column]:
            rho = F.exp(F.col("lnrho"))
            div = C.divergence(d, u)
            grad = C.gradient(d, "lnrho")
            strain = C.traceless_strain(d, u)
            out = {"d_lnrho": -C.u_dot_grad(d, u, "lnrho") - div}
            cs2 = F.lit(self.sound**2)
            if self.entropy:
                cs2 = cs2 * F.exp(F.lit(self.gamma / self.cp) * F.col("ss") + F.lit(self.gamma - 1) * F.col("lnrho"))
            press = [-cs2 * (g + (d.d("ss", i) / self.cp if self.entropy else 0.0)) for i, g in enumerate(grad)]
            gd, lap = C.gradient_of_divergence(d, u), C.laplace_vector(d, u)
            force = [F.lit(0.0)] * 3
            if self.magnetic:
                b, j = C.curl(d, a), C.curl_of_curl(d, a)
                force = [(j[(i + 1) % 3] * b[(i + 2) % 3] - j[(i + 2) % 3] * b[(i + 1) % 3]) / rho for i in range(3)]
                ub = [F.col(u[(i + 1) % 3]) * b[(i + 2) % 3] - F.col(u[(i + 2) % 3]) * b[(i + 1) % 3] for i in range(3)]
                out |= {f"d_{f}": ub[i] + self.resistivity * d_a for i, (f, d_a) in enumerate(zip(a, C.laplace_vector(d, a)))}
            for i in range(3):
                drag = self.viscosity * (lap[i] + gd[i] / 3 + 2 * sum((strain[i][k] * grad[k] for k in range(3)), F.lit(0.0))) + self.bulk * gd[i]
                push = self.forcing.columns(spec)[i] if self.forcing else F.lit(0.0)
                out[f"d_{u[i]}"] = -C.u_dot_grad(d, u, u[i]) + press[i] + force[i] + drag + push
            if self.entropy:
                t = cs2 / (self.cp * (self.gamma - 1))
                ln_t = [self.gamma / self.cp * d.d("ss", i) + (self.gamma - 1) * grad[i] for i in range(3)]
                lap_t = self.gamma / self.cp * C.laplace(d, "ss") + (self.gamma - 1) * C.laplace(d, "lnrho")
                heat = self.conductivity * (lap_t + sum((x * x for x in ln_t), F.lit(0.0))) / rho
                heat = heat + 2 * self.viscosity * C.contract(strain) / t
                if self.magnetic:
                    heat = heat + self.resistivity * sum((x * x for x in j), F.lit(0.0)) / (rho * t)
                out["d_ss"] = -C.u_dot_grad(d, u, "ss") + heat
            return out

        return lambda g, t: C.select(g, spec, build, tuple(c for c in g.columns if c not in AXES))


def sink_accretion(spec: GridSpec, density: str, radial_velocity: str) -> Column:
    """Aggregate: mass that flows inwards through the inner radial face in a unit of time, on spherical axes (x radius, y colatitude, z longitude)."""
    r, theta = spec.position(0), spec.position(1)
    area = r * r * F.sin(theta) * F.lit(float(spec.spacing[1] * spec.spacing[2]))
    flux = F.col(density) * F.greatest(F.lit(0.0), -F.col(radial_velocity)) * area
    return F.sum(F.when(F.col("x") == 0, flux).otherwise(0.0))


def sink_gravity(spec: GridSpec, mass: float, constant: float = 1.0) -> list[Column]:
    """Acceleration towards a mass at the centre, by components."""
    r = spec.position(0)
    return [-F.lit(float(constant * mass)) / (r * r), F.lit(0.0), F.lit(0.0)]


def walk(walkers: DataFrame, spec: GridSpec, steps: int, seed: int = 0, length: float = 1.0) -> DataFrame:
    """Random walkers (id, px, py, pz): steps of fixed length in directions drawn by id and step; periodic axes wrap."""
    out = walkers
    for k in range(steps):
        u = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.lit(i), "id"), 11).cast("double") / float(1 << 53) for i in range(2)]
        cos, phi = 2 * u[0] - 1, 2 * math.pi * u[1]
        sin = F.sqrt(1 - cos * cos)
        moved = []
        for a, d in enumerate((sin * F.cos(phi), sin * F.sin(phi), cos)):
            p = F.col(f"p{AXES[a]}") + length * d
            size = spec.n[a] * spec.spacing[a]
            moved.append(F.pmod(p - spec.origin[a], F.lit(size)) + spec.origin[a] if spec.periodic[a] else p)
        out = out.select("id", *(m.alias(f"p{a}") for m, a in zip(moved, AXES)))
    return out
