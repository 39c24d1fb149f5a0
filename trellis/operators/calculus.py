"""Vector calculus: expressions over derivatives that one shared stencil pass provides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import AXES, GridSpec
from . import stencil as S

Vector = tuple[str, str, str]


class Derivatives:
    """Collects the derivatives that expressions ask for, and computes them all in one pass."""

    def __init__(self, spec: GridSpec, accuracy: int = 6):
        self.spec, self.accuracy, self.asked = spec, accuracy, {}

    def of(self, field: str, orders: tuple[int, int, int], kind: str = "central") -> Column:
        if any(o and not self.spec.active(a) for a, o in enumerate(orders)):
            return F.lit(0.0)
        name = f"_{field}_{''.join(map(str, orders))}_{kind}"
        if name not in self.asked:
            d, axes = self.spec.spacing, [a for a in range(3) if orders[a]]
            if kind == "upwind":
                s = S.upwind_dissipation(axes[0], d[axes[0]])
            elif len(axes) == 2 and sum(orders) == 2:
                s = S.mixed(*axes, self.accuracy, (d[axes[0]], d[axes[1]]))
            elif len(axes) == 1:
                s = S.central(axes[0], orders[axes[0]], self.accuracy, d[axes[0]])
            else:
                s = S.crossed(orders, self.accuracy, d)
            self.asked[name] = (s, field)
        return F.col(name)

    def d(self, field: str, axis: int, order: int = 1) -> Column:
        return self.of(field, tuple(order if a == axis else 0 for a in range(3)))

    def dd(self, field: str, a: int, b: int) -> Column:
        return self.d(field, a, 2) if a == b else self.of(field, tuple(int(k in (a, b)) for k in range(3)))

    def compute(self, grid: DataFrame, keep: tuple[str, ...] = (), strategy: str | None = None) -> DataFrame:
        return S.apply(grid, self.spec, self.asked, keep, strategy)


def select(grid: DataFrame, spec: GridSpec, build, keep: tuple[str, ...] = (), accuracy: int = 6, strategy: str | None = None) -> DataFrame:
    """Keys, `keep`, and the columns {name: expression} that build(Derivatives) gives. keep: fields the expressions read themselves."""
    d = Derivatives(spec, accuracy)
    columns = build(d)
    return d.compute(grid, keep, strategy).select(*AXES, *keep, *(c.alias(k) for k, c in columns.items()))


def gradient(d: Derivatives, f: str) -> list[Column]:
    return [d.d(f, a) for a in range(3)]


def gradient_tensor(d: Derivatives, v: Vector) -> list[list[Column]]:
    return [gradient(d, f) for f in v]


def divergence(d: Derivatives, v: Vector) -> Column:
    return d.d(v[0], 0) + d.d(v[1], 1) + d.d(v[2], 2)


def curl(d: Derivatives, v: Vector) -> list[Column]:
    return [d.d(v[(a + 2) % 3], (a + 1) % 3) - d.d(v[(a + 1) % 3], (a + 2) % 3) for a in range(3)]


def laplace(d: Derivatives, f: str) -> Column:
    return d.d(f, 0, 2) + d.d(f, 1, 2) + d.d(f, 2, 2)


def laplace_vector(d: Derivatives, v: Vector) -> list[Column]:
    return [laplace(d, f) for f in v]


def hessian(d: Derivatives, f: str) -> list[list[Column]]:
    return [[d.dd(f, a, b) for b in range(3)] for a in range(3)]


def gradient_of_divergence(d: Derivatives, v: Vector) -> list[Column]:
    return [d.dd(v[0], a, 0) + d.dd(v[1], a, 1) + d.dd(v[2], a, 2) for a in range(3)]


def curl_of_curl(d: Derivatives, v: Vector) -> list[Column]:
    return [g - l for g, l in zip(gradient_of_divergence(d, v), laplace_vector(d, v))]


def del_power(d: Derivatives, f: str, order: int) -> Column:
    """Sum of the fourth or sixth derivatives along the axes."""
    return d.d(f, 0, order) + d.d(f, 1, order) + d.d(f, 2, order)


def biharmonic(d: Derivatives, f: str) -> Column:
    return del_power(d, f, 4) + 2 * (d.of(f, (2, 2, 0)) + d.of(f, (2, 0, 2)) + d.of(f, (0, 2, 2)))


def u_dot_grad(d: Derivatives, u: Vector, f: str) -> Column:
    return F.col(u[0]) * d.d(f, 0) + F.col(u[1]) * d.d(f, 1) + F.col(u[2]) * d.d(f, 2)


def u_dot_grad_vector(d: Derivatives, u: Vector, v: Vector) -> list[Column]:
    """By rows: component i is u . grad v_i."""
    return [u_dot_grad(d, u, f) for f in v]


def u_dot_grad_upwind(d: Derivatives, u: Vector, f: str) -> Column:
    """u . grad f less |u_i| times the sixth difference over 60 spacings."""
    out = u_dot_grad(d, u, f)
    for a in range(3):
        if d.spec.active(a):
            out = out - F.abs(F.col(u[a])) * d.of(f, tuple(6 if k == a else 0 for k in range(3)), "upwind")
    return out


def traceless_strain(d: Derivatives, v: Vector) -> list[list[Column]]:
    g = gradient_tensor(d, v)
    third = divergence(d, v) / 3
    return [[(g[a][b] + g[b][a]) / 2 - third if a == b else (g[a][b] + g[b][a]) / 2 for b in range(3)] for a in range(3)]


def contract(a: list[list[Column]], b: list[list[Column]] | None = None) -> Column:
    b = b or a
    return sum((x * y for r, s in zip(a, b) for x, y in zip(r, s)), F.lit(0.0))


def spherical(d: Derivatives, f: str, r: Column, theta: Column) -> dict[str, Column]:
    """Gradient and Laplacian where x is radius, y colatitude and z longitude."""
    fr, ft, fp = d.d(f, 0), d.d(f, 1), d.d(f, 2)
    sin = F.sin(theta)
    lap = d.d(f, 0, 2) + 2 * fr / r + (d.d(f, 1, 2) + F.cos(theta) / sin * ft) / (r * r) + d.d(f, 2, 2) / (r * sin) ** 2
    return {"grad_r": fr, "grad_theta": ft / r, "grad_phi": fp / (r * sin), "laplace": lap}


def cylindrical(d: Derivatives, f: str, r: Column) -> dict[str, Column]:
    """Gradient and Laplacian where x is radius, y azimuth and z height."""
    fr, fp = d.d(f, 0), d.d(f, 1)
    return {"grad_r": fr, "grad_phi": fp / r, "grad_z": d.d(f, 2), "laplace": d.d(f, 0, 2) + fr / r + d.d(f, 1, 2) / (r * r) + d.d(f, 2, 2)}


def spherical_vector(d: Derivatives, v: Vector, r: Column, theta: Column) -> dict[str, Column]:
    """Divergence and curl of a vector of radial, polar and azimuthal components; they read the components themselves."""
    sin, cot = F.sin(theta), F.cos(theta) / F.sin(theta)
    vr, vt, vp = map(F.col, v)
    return {
        "div": d.d(v[0], 0) + 2 * vr / r + (d.d(v[1], 1) + cot * vt) / r + d.d(v[2], 2) / (r * sin),
        "curl_r": (d.d(v[2], 1) + cot * vp) / r - d.d(v[1], 2) / (r * sin),
        "curl_theta": d.d(v[0], 2) / (r * sin) - vp / r - d.d(v[2], 0),
        "curl_phi": d.d(v[1], 0) + vt / r - d.d(v[0], 1) / r,
    }


def matrix_divergence(d: Derivatives, m: tuple[Vector, Vector, Vector]) -> list[Column]:
    """Of a tensor, row by row."""
    return [divergence(d, row) for row in m]


def matrix_curl(d: Derivatives, m: tuple[Vector, Vector, Vector]) -> list[list[Column]]:
    return [curl(d, row) for row in m]


def stretched(d: Derivatives, f: str, axis: int, slope: Column, bend: Column | None = None) -> tuple[Column, Column]:
    """First and second derivative on a non-equidistant axis: slope is d(index)/d(coordinate), bend its own derivative."""
    first = d.d(f, axis)
    second = d.d(f, axis, 2) * slope * slope
    return first * slope, second + first * bend if bend is not None else second


def shock(grid: DataFrame, spec: GridSpec, v: Vector, keep: tuple[str, ...] = (), accuracy: int = 6) -> DataFrame:
    """Shock viscosity: converging flow, its maximum over the neighbours that an order's stencils reach, smoothed, times the least spacing squared."""
    conv = select(grid, spec, lambda d: {"_c": F.greatest(-divergence(d, v), F.lit(0.0))}, keep, accuracy)
    peak = S.apply(conv, spec, {"_m": (S.local_max(1) if accuracy == 2 else S.ball(3), "_c")}, keep)
    axes = tuple(a for a in range(3) if spec.active(a))
    least = min((spec.spacing[a] for a in axes), default=1.0)
    return S.apply(peak, spec, {"shock": (S.smooth(accuracy, axes).scaled(least * least), "_m")}, keep)


def limited_slopes(left: Column, right: Column) -> Column:
    """minmod: the smaller of two slopes of one sign, else 0."""
    return F.when(left * right <= 0, 0.0).otherwise(F.when(F.abs(left) < F.abs(right), left).otherwise(right))


def slope_limited_diffusion(grid: DataFrame, spec: GridSpec, f: str, speed: str, steepness: float = 2.0, power: float = 1.0, keep: tuple[str, ...] = (), ln_field: bool = False) -> DataFrame:
    """Divergence of the fluxes at the cells' faces: speed/2 at the face, times the jump of limited reconstructions there, times Q.

    Q = min(1, steepness * jump / step) ** power, step being the difference of the two cells' values; 0 where jump and step have
    other signs or there is no step. ln_field: the field is a logarithm, its exponential is diffused. speed: the field of the characteristic speed.
    """
    taps = {}
    for a in range(3):
        if spec.active(a):
            for k in (-2, -1, 1, 2):
                taps[f"_{a}_{k}"] = (S.Stencil.of({S._on(a, k): 1.0}), f)
            for k in (-1, 1):
                taps[f"_c{a}_{k}"] = (S.Stencil.of({S._on(a, k): 1.0}), speed)
    g = S.apply(grid, spec, taps, tuple(dict.fromkeys((f, speed, *keep))))
    total = F.lit(0.0)
    value = (lambda c: F.exp(c)) if ln_field else (lambda c: c)
    for a in range(3):
        if not spec.active(a):
            continue
        v = {k: value(F.col(f"_{a}_{k}")) for k in (-2, -1, 1, 2)} | {0: value(F.col(f))}
        slope = {k: limited_slopes(v[k] - v[k - 1], v[k + 1] - v[k]) / 2 for k in (-1, 0, 1)}

        def flux(k, a=a, v=v, slope=slope):
            """Through the face between the cells k and k + 1."""
            jump, across = (v[k + 1] - slope[k + 1]) - (v[k] + slope[k]), v[k + 1] - v[k]
            q = F.when(jump * across > 0, F.pow(F.least(F.lit(1.0), steepness * jump / across), F.lit(float(power)))).otherwise(0.0)
            c = (F.col(speed) + F.col(f"_c{a}_{1 if k == 0 else -1}")) / 2
            return c / 2 * q * jump

        total = total + (flux(0) - flux(-1)) / spec.spacing[a]
    return g.select(*AXES, *keep, total.alias("diffusion"))
