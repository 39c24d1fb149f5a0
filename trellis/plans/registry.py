"""The queries over grids, and their SQL.

The grids of the queries hold whole numbers, and stencils in them are scaled to whole weights, so that sums don't depend on
their order and both engines give the same bits; divisions come once, at the end.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as M
from ..operators import boundary as B
from ..operators import calculus as C
from ..operators import harmonics, integrate, ray, solvers, spectral, transfer
from ..operators import reduce as R
from ..operators import stencil as S
from ..sources.tables import GRID, LINES, SIDE, event_grid, line_grid
from ..spec import AXES, GridSpec
from .steps import Kernel, Steps

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
V = ("f", "g", "h")


def query(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return wrap


def whole(s: S.Stencil, by: int) -> S.Stencil:
    """The stencil times a common denominator of its weights."""
    out = {t: round(c * by) for t, c in s.taps}
    if any(abs(c * by - out[t]) > 1e-6 for t, c in s.taps):
        raise ValueError(f"{by} is no common denominator")
    return S.Stencil.of(out, s.op)


def taps_sql(stencils: dict[str, tuple[S.Stencil, str]], keep: tuple[str, ...] = (), source: str = "grid", spec: GridSpec = LINES) -> str:
    """SELECT with a column for each stencil of a field; axes wrap where spec is periodic."""
    every = sorted({t for s, _ in stencils.values() for t, _ in s.taps} | {(0, 0, 0)})
    names = list(stencils)

    def cell(n, t):
        at = dict(stencils[n][0].taps)
        missing = "CAST(NULL AS DOUBLE)" if stencils[n][0].op == "max" else "CAST(0 AS DOUBLE)"
        return f"CAST({at[t]!r} AS DOUBLE)" if t in at else missing

    rows = ", ".join(f"({t[0]}, {t[1]}, {t[2]}, {', '.join(cell(n, t) for n in names)})" for t in every)
    to = ", ".join(f"CAST((({a} - d{a}) % {k} + {k}) % {k} AS INTEGER) AS {a}" if p else f"{a} - d{a} AS {a}" for a, k, p in zip(AXES, spec.n, spec.periodic))
    inside = " AND ".join(f"{a} BETWEEN 0 AND {k - 1}" for a, k in zip(AXES, spec.n))
    cols = ", ".join([f"c_{n} * {stencils[n][1]} AS v_{n}" for n in names] + [f"CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN {k} END AS v_{k}" for k in keep])
    aggs = ", ".join([f"{stencils[n][0].op}(v_{n}) AS {n}" for n in names] + [f"max(v_{k}) AS {k}" for k in keep])
    return f"SELECT x, y, z, {aggs} FROM (SELECT {to}, {cols} FROM {source}, (VALUES {rows}) AS taps(dx, dy, dz, {', '.join(f'c_{n}' for n in names)})) WHERE {inside} GROUP BY x, y, z"


def with_grid(body: str) -> str:
    return f"WITH {GRID}\n{body}"


def stencil_query(name: str, stencils: dict[str, tuple[S.Stencil, str]], over: int = 1, keep: tuple[str, ...] = ()):
    """Registers stencils scaled to whole weights by `over`, divided by it at the end."""
    scaled = {k: (whole(s, over), f) for k, (s, f) in stencils.items()}
    cols = ", ".join(f"{k} / {float(over)} AS {k}" for k in stencils)

    @query(name, with_grid(f"SELECT x, y, z, {cols}{''.join(f', {k}' for k in keep)} FROM ({taps_sql(scaled, keep)})"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = S.apply(line_grid(spark, sf_dir), LINES, scaled, keep)
        return d.select(*AXES, *((F.col(k) / float(over)).alias(k) for k in stencils), *keep)


@query("scan_dense_grid", with_grid("SELECT x, y, z, f, g, h, w FROM grid"))
def scan_dense_grid(spark, sf_dir):
    return line_grid(spark, sf_dir)


@query("pointwise_scalar_functions", with_grid("""SELECT x, y, z,
  f - 7 * trunc(f / 7) AS mod_f, (h - 40) - 7 * floor((h - 40) / 7) AS modulo_h,
  CASE WHEN f / 4 < 0 THEN -floor(-f / 4 + 0.5) ELSE floor(f / 4 + 0.5) END AS nint_f,
  CASE WHEN g < 10 THEN CAST(10 AS DOUBLE) ELSE g END AS at_least, CASE WHEN g > 20 THEN CAST(20 AS DOUBLE) ELSE g END AS at_most,
  CASE WHEN abs(w - 60) < 20 THEN CAST(0 AS DOUBLE) ELSE w - 60 END AS cut,
  CASE WHEN (f - 300) * (h - 40) <= 0 THEN CAST(0 AS DOUBLE) WHEN abs(f - 300) < abs(h - 40) THEN f - 300 ELSE h - 40 END AS minmod_fh,
  (x + y + z) % 3 = 1 AS colour FROM grid"""))
def pointwise_scalar_functions(spark, sf_dir):
    f, g, h, w = map(F.col, "fghw")
    return line_grid(spark, sf_dir).select(
        *AXES, M.mod(f, 7.0).alias("mod_f"), M.modulo(h - 40, 7.0).alias("modulo_h"), M.nint(f / 4).cast("double").alias("nint_f"), M.set_min(g, 10).alias("at_least"),
        M.set_max(g, 20).alias("at_most"), M.zero_below(w - 60, 20).alias("cut"), M.minmod(f - 300, h - 40).alias("minmod_fh"), M.colour(3, 1).alias("colour"))


@query("kernel_on_sub_volume", with_grid("SELECT x, y, z, CASE WHEN x >= 2 AND x < 9 AND z < 5 THEN f * 2 + 1 ELSE f END AS f, g FROM grid"))
def kernel_on_sub_volume(spark, sf_dir):
    from .steps import windowed

    return windowed(line_grid(spark, sf_dir), {"f": F.col("f") * 2 + 1}, F.col("x").between(2, 8) & (F.col("z") < 5)).select(*AXES, "f", "g")


@query("slice_mid_plane", with_grid(f"SELECT x, y, z, f, g, h, w FROM grid WHERE z = {SIDE // 2}"))
def slice_mid_plane(spark, sf_dir):
    return R.mid_slice(line_grid(spark, sf_dir), LINES)


@query("boundary_plates", with_grid(f"SELECT x, y, z, f FROM grid WHERE y < 3 OR y >= {SIDE - 3}"))
def boundary_plates(spark, sf_dir):
    g = line_grid(spark, sf_dir).select(*AXES, "f")
    return R.band(g, y=(0, 3)).unionByName(R.band(g, y=(SIDE - 3, SIDE)))


@query("transpose_axes", with_grid("SELECT z AS x, y, x AS z, f, g, h, w FROM grid"))
def transpose_axes(spark, sf_dir):
    return R.transposed(line_grid(spark, sf_dir), "zyx")


@query("scatter_add", with_grid("SELECT CAST(CAST(h AS BIGINT) % 5 AS INTEGER) AS slot, sum(f) AS total FROM grid GROUP BY 1"))
def scatter_add(spark, sf_dir):
    return R.scatter_add(line_grid(spark, sf_dir), [(F.col("h").cast("long") % 5).cast("int")], F.col("f"), ["slot"], "total")


@query("gather_by_computed_index", with_grid(f"SELECT a.x, a.y, a.z, a.f, b.g AS there FROM grid a LEFT JOIN grid b ON b.x = CAST(a.f AS BIGINT) % {SIDE} AND b.y = a.z AND b.z = a.y"))
def gather_by_computed_index(spark, sf_dir):
    g = line_grid(spark, sf_dir)
    at = {"x": (F.col("f").cast("long") % SIDE).cast("int"), "y": F.col("z"), "z": F.col("y")}
    return R.gather(g, g.select(*AXES, F.col("g").alias("value")), at, "value", "there").select(*AXES, "f", "there")


N = LINES.cells
_D2 = "((x - 7.5) * (x - 7.5) + (y - 7.5) * (y - 7.5) + (z - 7.5) * (z - 7.5))"
_IN = f"CASE WHEN sqrt({_D2}) <= 5 THEN 1.0 ELSE 0.0 END"


@query("reduce_scalars", with_grid("SELECT sum(f) AS sum_f, min(f) AS min_f, max(f) AS max_f, sqrt(sum(f * f)) AS l2_f, sum(f) / 4096.0 AS mean_f, sqrt(sum(h * h) / 4096.0) AS rms_h, sum(f) + 100.0 AS sum_add, max(isnan(f)) AS any_nan FROM (SELECT f, h FROM grid)"))
def reduce_scalars(spark, sf_dir):
    g = line_grid(spark, sf_dir)
    return g.agg(F.sum("f").alias("sum_f"), F.min("f").alias("min_f"), F.max("f").alias("max_f"), R.l2_norm("f", LINES).alias("l2_f"), (F.sum("f") / float(N)).alias("mean_f"),
                 R.expression("rms", ("h",), LINES).alias("rms_h"), (F.sum("f") + F.lit(100.0)).alias("sum_add"), R.has_nan("f").alias("any_nan"))


@query("reduce_vectors", with_grid("SELECT max(sqrt(f*f + g*g + h*h)) AS max_v, min(sqrt(f*f + g*g + h*h)) AS min_v, sqrt(sum(f*f + g*g + h*h) / 4096.0) AS rms_v, max(sqrt((f*f + g*g + h*h) / 1.0)) AS alfven_max, min(sqrt((f*f + g*g + h*h) / 1.0)) AS alfven_min, sqrt(sum((f*f + g*g + h*h) / 1.0) / 4096.0) AS alfven_rms FROM grid"))
def reduce_vectors(spark, sf_dir):
    g = line_grid(spark, sf_dir).withColumn("lnrho", F.lit(0.0))
    v4 = (*V, "lnrho")
    return R.scalars(g, LINES, {"max_v": ("max", V), "min_v": ("min", V), "rms_v": ("rms", V), "alfven_max": ("alfven_max", v4), "alfven_min": ("alfven_min", v4), "alfven_rms": ("alfven_rms", v4)})


@query("reduce_radial_windows", with_grid(f"SELECT max(f * {_IN}) AS r_max, min(f * {_IN}) AS r_min, sum(f * {_IN}) AS r_sum, sum((f*f + g*g + h*h) / 1.0 * {_IN}) AS a_sum, sqrt(sum((f*f + g*g + h*h) / 1.0 * {_IN}) / 523) AS a_rms FROM grid"))
def reduce_radial_windows(spark, sf_dir):
    g = line_grid(spark, sf_dir).withColumn("lnrho", F.lit(0.0))
    v4 = (*V, "lnrho")
    return R.scalars(g, LINES, {"r_max": ("radial_max", "f", 5.0), "r_min": ("radial_min", "f", 5.0), "r_sum": ("radial_sum", "f", 5.0), "a_sum": ("alfven_radial_sum", v4, 5.0), "a_rms": ("alfven_radial_rms", v4, 5.0)})


@query("reduce_gaussian_windows", with_grid(f"SELECT round(max(f * exp(-({_D2} / 25.0))), 6) AS g_max, round(min(f * exp(-({_D2} / 25.0))), 9) AS g_min, round(sum(f * exp(-({_D2} / 25.0))), 5) AS g_sum FROM grid"))
def reduce_gaussian_windows(spark, sf_dir):
    d = R.scalars(line_grid(spark, sf_dir), LINES, {"g_max": ("gaussian_max", "f", 5.0), "g_min": ("gaussian_min", "f", 5.0), "g_sum": ("gaussian_sum", "f", 5.0)})
    return d.select(F.round("g_max", 6).alias("g_max"), F.round("g_min", 9).alias("g_min"), F.round("g_sum", 5).alias("g_sum"))


@query("reduce_by_subdomain", with_grid("SELECT x // 8 AS sx, z // 8 AS sz, sum(f) AS total, max(g) AS most FROM grid GROUP BY 1, 2"))
def reduce_by_subdomain(spark, sf_dir):
    g = line_grid(spark, sf_dir).withColumns({"sx": F.expr("x div 8").cast("int"), "sz": F.expr("z div 8").cast("int")})
    return R.scalars(g, LINES, {"total": ("sum", "f"), "most": ("max", "g")}, by=("sx", "sz"))


for _axes in R.PROFILES:

    @query(f"profile_{_axes}", with_grid(f"SELECT {', '.join(_axes)}, sum(f) AS sum_f, sum(g) / {float(SIDE ** (3 - len(_axes)))} AS mean_g, max(h) AS max_h FROM grid GROUP BY {', '.join(_axes)}"))
    def _profile(spark, sf_dir, axes=_axes):
        return R.profile(line_grid(spark, sf_dir), axes, {"sum_f": F.sum("f"), "mean_g": F.sum("g") / float(SIDE ** (3 - len(axes))), "max_h": F.max("h")})


_SETS = ", ".join("(" + ", ".join(c) + ")" for k in (2, 1, 0) for c in combinations(AXES, k))


@query("profiles_in_one_pass", with_grid(f"SELECT x, y, z, sum(f) AS sum_f, max(g) AS max_g FROM grid GROUP BY GROUPING SETS ({_SETS})"))
def profiles_in_one_pass(spark, sf_dir):
    return R.profiles(line_grid(spark, sf_dir), {"sum_f": F.sum("f"), "max_g": F.max("g")})


@query("field_minus_profile", with_grid("SELECT x, y, g.z, f - m AS f FROM grid g JOIN (SELECT z, sum(f) / 256.0 AS m FROM grid GROUP BY z) p ON p.z = g.z"))
def field_minus_profile(spark, sf_dir):
    g = line_grid(spark, sf_dir)
    p = R.profile(g, "z", {"m": F.sum("f") / 256.0})
    return R.with_profile(g, p, "z").select(*AXES, (F.col("f") - F.col("m")).alias("f"))


_P = taps_sql({"d": (whole(S.central(2, 1, 6), 60), "p")}, source="(SELECT CAST(0 AS INTEGER) AS x, CAST(0 AS INTEGER) AS y, z, sum(f) AS p FROM grid GROUP BY z)", spec=GridSpec((1, 1, SIDE)))


@query("profile_derivative", with_grid(f"SELECT z, d / 60.0 AS d FROM ({_P})"))
def profile_derivative(spark, sf_dir):
    p = R.profile(line_grid(spark, sf_dir), "z", {"p": F.sum("f")}).select(F.lit(0).alias("x"), F.lit(0).alias("y"), "z", "p")
    d = S.apply(p, GridSpec((1, 1, SIDE)), {"d": (whole(S.central(2, 1, 6), 60), "p")})
    return d.select("z", (F.col("d") / 60.0).alias("d"))


for _acc, _over in ((2, 2), (4, 12), (6, 60), (8, 840)):
    stencil_query(f"first_derivatives_order_{_acc}", {f"d{a}": (S.central(i, 1, _acc), "f") for i, a in enumerate(AXES)}, _over)
for _acc, _over in ((2, 1), (4, 12), (6, 180), (8, 5040)):
    stencil_query(f"laplace_order_{_acc}", {"lap": (S.laplace(_acc), "f")}, _over)
stencil_query("second_derivatives", {f"d2{a}": (S.central(i, 2, 6), "f") for i, a in enumerate(AXES)}, 180)
stencil_query("mixed_derivatives", {"dxy": (S.mixed(0, 1), "f"), "dxz": (S.mixed(0, 2), "f"), "dyz": (S.mixed(1, 2), "f")}, 720)
stencil_query("third_to_sixth_derivatives", {f"d{k}{a}": (S.central(i, k, 6), "f") for k in (3, 4, 5, 6) for i, a in enumerate(AXES)}, 24)
stencil_query("crossed_derivatives", {"d4x2y": (S.crossed((4, 2, 0), 2), "f"), "d2x2y2z": (S.crossed((2, 2, 2), 2), "f"), "d5x1y": (S.crossed((5, 1, 0), 2), "f")}, 4)
stencil_query("upwind_derivatives", {"from_left": (S.upwind(0, -1), "f"), "from_right": (S.upwind(0, 1), "f"), "hyper": (S.upwind_dissipation(1), "f")}, 60)
stencil_query("one_sided_derivatives", {"up": (S.one_sided(2, 1), "f"), "down": (S.one_sided(2, -1), "f")}, 60)
stencil_query("box_average", {"mean": (S.average(1), "f")}, 27)
stencil_query("binomial_smooth", {"s": (S.binomial(1), "f"), "t": (S.binomial(1, (0, 1)), "g")}, 64)
stencil_query("midpoints", {f"m{a}{'pm'[s < 0]}": (S.midpoint(i, s), "f") for i, a in enumerate(AXES) for s in (1, -1)}, 2)
stencil_query("compact_poisson_order_4", {"lhs": (S.mehrstellen(4)[0], "f"), "rhs": (S.mehrstellen(4)[1], "g")}, 12)
stencil_query("compact_poisson_order_6", {"lhs": (S.mehrstellen(6)[0], "f"), "rhs": (S.mehrstellen(6)[1], "g")}, 1440)
for _r in (1, 2, 3):
    stencil_query(f"local_maximum_{_r}", {"m": (S.local_max(_r), "f")}, 1)


#: Added before rounding: binary fractions lie on ties, where the last bit would decide.
OFF_TIES = 3.1e-8


def rounded_query(name: str, sql: str, run, columns: tuple[str, ...], digits: int = 6):
    """Results that depend on the order of sums: keys as they are, the columns rounded on both sides."""
    cols = ", ".join(f"round({c} + {OFF_TIES}, {digits}) + 0.0 AS {c}" for c in columns)

    @query(name, with_grid(f"SELECT x, y, z, {cols} FROM ({sql})"))
    def rounded(spark, sf_dir):
        return run(spark, sf_dir).select(*AXES, *((F.round(F.col(c) + F.lit(OFF_TIES), digits) + 0.0).alias(c) for c in columns))


for _r in (3, 5):
    rounded_query("gaussian_smooth" if _r == 3 else "gaussian_smooth_5", taps_sql({"s": (S.gaussian(_r), "f")}), lambda spark, sf_dir, r=_r: S.apply(line_grid(spark, sf_dir), LINES, {"s": (S.gaussian(r), "f")}), ("s",))
stencil_query("shock_smooth", {"s": (S.smooth(6), "f")}, 180**3)
stencil_query("ball_maximum", {"m": (S.ball(3), "f")}, 1)


@query("exponential_sum", with_grid(f"SELECT x, y, z, round(v, 6) + 0.0 AS s FROM ({taps_sql({'v': (S.box(1, op='sum'), 'e')}, source='(SELECT x, y, z, exp(g / 100.0) AS e FROM grid)')})"))
def exponential_sum(spark, sf_dir):
    s = S.Stencil.of(dict(S.box(1).taps), "expsum")
    d = S.apply(line_grid(spark, sf_dir).select(*AXES, (F.col("g") / 100.0).alias("l")), LINES, {"s": (s, "l")})
    return d.select(*AXES, (F.round("s", 6) + 0.0).alias("s"))


def calculus_query(name: str, over: dict[str, tuple[S.Stencil, str]], den: int, columns: dict[str, str], build, keep: tuple[str, ...] = ()):
    """columns: SQL over the derivatives, which are whole numbers there; the same expression in Spark comes from the same scaled pass."""
    scaled = {k: (whole(s, den), f) for k, (s, f) in over.items()}
    sql = ", ".join(f"{e} AS {k}" for k, e in columns.items())

    @query(name, with_grid(f"SELECT x, y, z, {sql} FROM ({taps_sql(scaled, keep)})"))
    def run(spark, sf_dir):
        class Whole(C.Derivatives):
            """Derivatives times their common denominator."""

            def of(self, *a, **k):
                c = super().of(*a, **k)
                self.asked = {n: (s if all(float(v).is_integer() for _, v in s.taps) else whole(s, den) if n not in done else s, f) for n, (s, f) in self.asked.items()}
                done.update(self.asked)
                return c

        done: set = set()
        d = Whole(LINES)
        cols = build(d)
        return d.compute(line_grid(spark, sf_dir), keep).select(*AXES, *(c.alias(k) for k, c in cols.items()))


_D1 = {f"{f}{a}": (S.central(i, 1, 6), f) for f in V for i, a in enumerate(AXES)}
calculus_query("gradient", {k: v for k, v in _D1.items() if k[0] == "f"}, 60, {"gx": "fx / 60.0", "gy": "fy / 60.0", "gz": "fz / 60.0"}, lambda d: {k: c / 60.0 for k, c in zip(("gx", "gy", "gz"), C.gradient(d, "f"))})
calculus_query("divergence", _D1, 60, {"div": "(fx + gy + hz) / 60.0"}, lambda d: {"div": C.divergence(d, V) / 60.0})
calculus_query("curl", _D1, 60, {"cx": "(hy - gz) / 60.0", "cy": "(fz - hx) / 60.0", "cz": "(gx - fy) / 60.0"}, lambda d: {k: c / 60.0 for k, c in zip(("cx", "cy", "cz"), C.curl(d, V))})
calculus_query("velocity_dot_gradient", _D1, 60, {"adv": "(f * fx + g * fy + h * fz) / 60.0"}, lambda d: {"adv": C.u_dot_grad(d, V, "f") / 60.0}, V)
_D6 = {f"s{a}": (S.central(i, 6, 6), "f") for i, a in enumerate(AXES)}
calculus_query("del6", _D6, 1, {"d6": "sx + sy + sz"}, lambda d: {"d6": C.del_power(d, "f", 6)})
calculus_query("traceless_strain", _D1, 60, {"xy": "(fy + gx) / 2", "yz": "(gz + hy) / 2", "xx": "(fx + fx) / 2 - (fx + gy + hz) / 3"}, lambda d: (lambda s: {"xy": s[0][1], "yz": s[1][2], "xx": s[0][0]})(C.traceless_strain(d, V)))


def _plain(build, keep=()):
    return lambda spark, sf_dir: C.select(line_grid(spark, sf_dir), LINES, build, keep)


_DD = {f"{f}{a}{b}": (S.central(i, 2, 6) if i == j else S.mixed(i, j), f) for f in V for i, a in enumerate(AXES) for j, b in enumerate(AXES) if j >= i}
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_dd = lambda f, i, j: f"{f}{AXES[min(i, j)]}{AXES[max(i, j)]}"
calculus_query("hessian", {k: v for k, v in _DD.items() if k[0] == "f"}, 720, {f"h{AXES[i]}{AXES[j]}": f"{_dd('f', i, j)} / 720.0" for i, j in _PAIRS}, lambda d: {f"h{AXES[i]}{AXES[j]}": C.hessian(d, "f")[i][j] / 720.0 for i, j in _PAIRS})
_GD = [" + ".join(_dd(f, i, j) for j, f in enumerate(V)) for i in range(3)]
_LV = [" + ".join(_dd(f, j, j) for j in range(3)) for f in V]
calculus_query("gradient_of_divergence", _DD, 720, {f"{a}_": f"({_GD[i]}) / 720.0" for i, a in enumerate(AXES)}, lambda d: {f"{a}_": C.gradient_of_divergence(d, V)[i] / 720.0 for i, a in enumerate(AXES)})
calculus_query("curl_of_curl", _DD, 720, {f"{a}_": f"(({_GD[i]}) - ({_LV[i]})) / 720.0" for i, a in enumerate(AXES)}, lambda d: {f"{a}_": C.curl_of_curl(d, V)[i] / 720.0 for i, a in enumerate(AXES)})
_B4 = {f"q{a}": (S.central(i, 4, 6), "f") for i, a in enumerate(AXES)} | {f"p{k}": (S.crossed(o, 6), "f") for k, o in enumerate(((2, 2, 0), (2, 0, 2), (0, 2, 2)))}
calculus_query("biharmonic", _B4, 32400, {"b": "(qx + qy + qz + 2 * (p0 + p1 + p2)) / 32400.0"}, lambda d: {"b": C.biharmonic(d, "f") / 32400.0})
_UP = {f"f{a}": (S.central(i, 1, 6), "f") for i, a in enumerate(AXES)} | {f"u{a}": (S.upwind_dissipation(i), "f") for i, a in enumerate(AXES)}
calculus_query("upwind_advection", _UP, 60, {"adv": "(f * fx + g * fy + h * fz - abs(f) * ux - abs(g) * uy - abs(h) * uz) / 60.0"}, lambda d: {"adv": C.u_dot_grad_upwind(d, V, "f") / 60.0}, V)
_D1H = {k: v for k, v in _D1.items()}
calculus_query("matrix_divergence", _D1H, 60, {f"d{a}": "(" + " + ".join(f"{f}{b}" for f, b in zip(r, AXES)) + ") / 60.0" for a, r in zip(AXES, ("fgh", "ghf", "hfg"))}, lambda d: {f"d{a}": c / 60.0 for a, c in zip(AXES, C.matrix_divergence(d, (("f", "g", "h"), ("g", "h", "f"), ("h", "f", "g"))))})
calculus_query("matrix_curl", _D1H, 60, {f"c{i}{j}": f"({m[i][(j + 2) % 3]}{AXES[(j + 1) % 3]} - {m[i][(j + 1) % 3]}{AXES[(j + 2) % 3]}) / 60.0" for m in [("fgh", "ghf", "hfg")] for i in range(3) for j in range(3)}, lambda d: {f"c{i}{j}": C.matrix_curl(d, (("f", "g", "h"), ("g", "h", "f"), ("h", "f", "g")))[i][j] / 60.0 for i in range(3) for j in range(3)})
_CONV = f"SELECT x, y, z, greatest(-(fx + gy + hz), CAST(0 AS DOUBLE)) AS c FROM ({taps_sql({k: (whole(s, 60), f) for k, (s, f) in _D1.items()})})"
_PEAK = taps_sql({"m": (S.ball(3), "c")}, source=f"({_CONV})")
rounded_query("shock_profile", f"SELECT x, y, z, v / {60.0 * 180**3} AS shock FROM ({taps_sql({'v': (whole(S.smooth(6), 180**3), 'm')}, source=f'({_PEAK})')})", lambda spark, sf_dir: C.shock(line_grid(spark, sf_dir), LINES, V), ("shock",))
_NEAR = {f"{n}{a}{'mp'[k > 0]}{abs(k)}": (S.Stencil.of({S._on(i, k): 1.0}), c) for n, c, ks in (("v", "f", (-2, -1, 1, 2)), ("c", "g", (-1, 1))) for i, a in enumerate(AXES) for k in ks}


def _minmod_sql(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) * ({b}) <= 0 THEN 0.0 WHEN abs({a}) < abs({b}) THEN {a} ELSE {b} END)"


def _face_sql(a: str, side: int) -> str:
    at = lambda k: f"v{a}{'mp'[k > 0]}{abs(k)}" if k else "f"
    slope = lambda k: _minmod_sql(f"{at(k)} - {at(k - 1)}", f"{at(k + 1)} - {at(k)}") + " / 2"
    lo, hi = (0, 1) if side > 0 else (-1, 0)
    jump, across = f"(({at(hi)} - {slope(hi)}) - ({at(lo)} + {slope(lo)}))", f"({at(hi)} - {at(lo)})"
    return f"((g + c{a}{'p' if side > 0 else 'm'}1) / 4 * (CASE WHEN {jump} * {across} > 0 THEN pow(least(1.0, 2 * {jump} / {across}), 1.5) ELSE 0.0 END) * {jump})"


rounded_query("slope_limited_diffusion", f"SELECT x, y, z, {' + '.join(f'({_face_sql(a, 1)} - {_face_sql(a, -1)})' for a in AXES)} AS diffusion FROM ({taps_sql(_NEAR, ('f', 'g'))})", lambda spark, sf_dir: C.slope_limited_diffusion(line_grid(spark, sf_dir), LINES, "f", "g", 2.0, 1.5), ("diffusion",))
_OPEN = GridSpec(LINES.n, periodic=(False, False, False))
_E = SIDE - 1


def _ghost_sql(low: str, high: str) -> str:
    """low and high: the ghost's value from m (the mirror) and e (the edge)."""
    side = lambda at, src, edge, v: f"SELECT CAST({at} AS INTEGER) AS x, a.y, a.z, {v} AS f FROM (VALUES (1), (2), (3)) d(k) JOIN grid a ON a.x = {src} JOIN grid b ON b.x = {edge} AND a.y = b.y AND a.z = b.z"
    lo, hi = (s.replace("{m}", "a.f").replace("{e}", "b.f") for s in (low, high))
    return side("-k", "k", 0, lo) + " UNION ALL " + side(f"{_E} + k", f"{_E} - k", _E, hi)


for _kind, _low, _high in (
    ("symmetric", "{m}", "{m}"), ("antisymmetric", "-{m}", "-{m}"), ("relative", "2 * {e} - {m}", "2 * {e} - {m}"), ("constant", "CAST(3 AS DOUBLE)", "CAST(3 AS DOUBLE)"),
    ("derivative", "{m} - 2 * k * 3.0", "{m} + 2 * k * 3.0"), ("outflow", "CASE WHEN -{e} > 0 THEN {m} ELSE -{m} END", "CASE WHEN {e} > 0 THEN {m} ELSE -{m} END"),
    ("inflow", "CASE WHEN -{e} > 0 THEN -{m} ELSE {m} END", "CASE WHEN {e} > 0 THEN -{m} ELSE {m} END"),
):
    _body = f"CASE WHEN x IN (0, {_E}) THEN CAST(0 AS DOUBLE) ELSE f END AS f" if _kind == "antisymmetric" else "f"

    @query(f"boundary_{_kind}", with_grid(f"SELECT x, y, z, {_body} FROM grid UNION ALL {_ghost_sql(_low, _high)}"))
    def _boundary(spark, sf_dir, kind=_kind):
        return B.extend(line_grid(spark, sf_dir), _OPEN, {"f": B.Condition(kind, 3.0)}, 0, 3)


@query("boundary_periodic", with_grid(f"SELECT x, y, z, f FROM grid UNION ALL SELECT x - {SIDE}, y, z, f FROM grid WHERE x >= {SIDE - 3} UNION ALL SELECT x + {SIDE}, y, z, f FROM grid WHERE x < 3"))
def boundary_periodic(spark, sf_dir):
    return B.extend(line_grid(spark, sf_dir), LINES, {"f": B.Condition("periodic")}, 0, 3)


_OUT = ", ".join(f"({s * (d + 1) + (0 if s < 0 else _E)}, {(0 if s < 0 else _E) - s * k}, {w})" for s in (-1, 1) for d, row in enumerate(B._continuation(3)) for k, w in enumerate(row))


@query("boundary_one_sided", with_grid(f"SELECT x, y, z, f FROM grid UNION ALL SELECT x, y, CAST(ghost AS INTEGER) AS z, sum(f * CAST(weight AS DOUBLE)) AS f FROM grid JOIN (VALUES {_OUT}) AS o(ghost, cell, weight) ON grid.z = o.cell GROUP BY 1, 2, 3"))
def boundary_one_sided(spark, sf_dir):
    return B.extend(line_grid(spark, sf_dir), _OPEN, {"f": B.Condition("one_sided")}, 2, 3)


QUERIES["boundary_shear"] = lambda spark, sf_dir: B.shear_shift(line_grid(spark, sf_dir), LINES, "f", 2.25, 3)


@query("laplace_in_a_closed_box", with_grid("SELECT x, y, z, lap FROM (" + taps_sql({"lap": (S.laplace(2), "f")}, source="(SELECT CAST(a.range - 1 AS INTEGER) AS x, CAST(b.range - 1 AS INTEGER) AS y, CAST(c.range - 1 AS INTEGER) AS z, g.f FROM range(18) a, range(18) b, range(18) c JOIN grid g ON g.x = CASE a.range WHEN 0 THEN 1 WHEN 17 THEN 14 ELSE a.range - 1 END AND g.y = CASE b.range WHEN 0 THEN 1 WHEN 17 THEN 14 ELSE b.range - 1 END AND g.z = CASE c.range WHEN 0 THEN 1 WHEN 17 THEN 14 ELSE c.range - 1 END)", spec=_OPEN) + ")"))
def laplace_in_a_closed_box(spark, sf_dir):
    g = B.surround(line_grid(spark, sf_dir).select(*AXES, "f"), _OPEN, {"f": B.Condition("symmetric")}, 1)
    return S.apply(g, _OPEN, {"lap": (S.laplace(2), "f")})


def _line_sql(d) -> tuple[str, str]:
    lead = max(a for a in range(3) if d[a])
    step = f"({AXES[lead]} * {d[lead]})"
    return ", ".join(f"{AXES[a]} - {d[a]} * {step}" for a in range(3) if a != lead), step


for _n in ("ppp", "mpz", "zzm", "pzp", "zpp", "left"):
    _k, _s = _line_sql(ray.DIRECTIONS[_n])

    @query(f"ray_sum_{_n}", with_grid(f"SELECT x, y, z, sum(f) OVER w AS total, lag(g, 1, CAST(0 AS DOUBLE)) OVER w AS before, first_value(h) OVER w AS entry FROM grid WINDOW w AS (PARTITION BY {_k} ORDER BY {_s})"))
    def _ray(spark, sf_dir, d=ray.DIRECTIONS[_n]):
        return line_grid(spark, sf_dir).select(*AXES, ray.running(F.col("f"), d).alias("total"), ray.incoming(F.col("g"), d, 0.0).alias("before"), ray.at_entry(F.col("h"), d).alias("entry"))


_k, _s = _line_sql((1, 1, 1))


@query("ray_recurrence", with_grid(f"SELECT a.x, a.y, a.z, sum(b.f * pow(0.5, a.s - b.s)) AS q FROM (SELECT *, {_s} AS s, row({_k}) AS line FROM grid) a JOIN (SELECT *, {_s} AS s, row({_k}) AS line FROM grid) b ON a.line = b.line AND b.s <= a.s GROUP BY 1, 2, 3"))
def ray_recurrence(spark, sf_dir):
    return ray.recurrence(line_grid(spark, sf_dir), (1, 1, 1), F.lit(0.5), F.col("f"), "q").select(*AXES, "q")


_RAYS = """p AS (
  SELECT *, coalesce(lag(chi) OVER w, chi) AS cm, coalesce(lead(chi) OVER w, chi) AS cp, coalesce(lag(f) OVER w, f) AS sm, coalesce(lead(f) OVER w, f) AS sp
  FROM (SELECT *, (g + 1) / 64 AS chi FROM grid) WINDOW w AS (PARTITION BY x, y ORDER BY z)
), d AS (
  SELECT *, greatest(sqrt(cm * chi), 5 * 2.220446049250313e-16) AS m, greatest(sqrt(cp * chi), 5 * 2.220446049250313e-16) AS p FROM p
), e AS (
  SELECT *, ((sp - f) / p * m + (f - sm) / m * p) / (m + p) AS s1, 2.0 * ((sp - f) / p - (f - sm) / m) / (m + p) AS s2, m * (1 - 0.5 * m * (1 - m / 3)) AS thin FROM d
), c AS (
  SELECT x, y, z, m, CASE WHEN m < 0.0001953125 THEN 1 - thin ELSE exp(-m) END AS a,
    -s1 * (CASE WHEN m < 0.0001953125 THEN thin ELSE 1 - exp(-m) END) - s2 * (CASE WHEN m < 0.0001953125 THEN -(m * m) * (0.5 - m / 3) ELSE exp(-m) * (1 + m) - 1 END) AS b FROM e
), r AS (
  SELECT x, y, z, b AS q, m AS tau FROM c WHERE z = 0
  UNION ALL SELECT c.x, c.y, c.z, c.a * r.q + c.b AS q, r.tau + c.m AS tau FROM r JOIN c ON c.x = r.x AND c.y = r.y AND c.z = r.z + 1
)"""


def _radiation(spark, sf_dir):
    g = line_grid(spark, sf_dir).withColumn("chi", (F.col("g") + 1) / 64)
    return ray.radiation(g, LINES, (0, 0, 1), "chi", "f", "q").select(*AXES, (F.round("q", 4) + 0.0).alias("q"), F.round("tau", 6).alias("tau"), (F.round(ray.extrinsic(F.col("q"), F.lit(100.0), F.col("tau")), 4) + 0.0).alias("lit"))


query("ray_radiation", f"WITH RECURSIVE {GRID}, {_RAYS} SELECT x, y, z, round(q, 4) + 0.0 AS q, round(tau, 6) AS tau, round(q + 100.0 * exp(-tau), 4) + 0.0 AS lit FROM r")(_radiation)


@query("ray_optical_depth", with_grid("SELECT x, y, z, round(sum(sqrt(g * before)) OVER (PARTITION BY x, y ORDER BY z), 6) AS tau FROM (SELECT *, coalesce(lag(g) OVER (PARTITION BY x, y ORDER BY z), g) AS before FROM grid)"))
def ray_optical_depth(spark, sf_dir):
    d = ray.optical_depth(line_grid(spark, sf_dir), (0, 0, 1), "g", 1.0, "tau")
    return d.select(*AXES, F.round("tau", 6).alias("tau"))


rounded_query("ray_periodic", f"SELECT a.x, a.y, a.z, sum(b.f * pow(-0.5, (a.x - b.x + {SIDE}) % {SIDE})) / (1 - pow(-0.5, {SIDE})) AS q FROM grid a JOIN grid b ON a.y = b.y AND a.z = b.z GROUP BY 1, 2, 3", lambda spark, sf_dir: ray.closed(line_grid(spark, sf_dir).withColumns({"a": F.lit(-0.5), "b": F.col("f")}), 0, 1, "a", "b", "q").select(*AXES, "q"), ("q",))
_W = {-1: 0.25, 0: 0.5, 1: 0.25}
_REST = S.Stencil.of({(i, j, k): _W[i] * _W[j] * _W[k] for i in _W for j in _W for k in _W})


@query("restrict_full_weighting", with_grid(f"SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, v AS f FROM ({taps_sql({'v': (_REST, 'f')})}) WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0"))
def restrict_full_weighting(spark, sf_dir):
    return transfer.restrict(line_grid(spark, sf_dir), LINES, ("f",))


_HALF = {-1: 0.5, 0: 1.0, 1: 0.5}
_PRO = ", ".join(f"({i}, {j}, {k}, {_HALF[i] * _HALF[j] * _HALF[k]!r})" for i in _HALF for j in _HALF for k in _HALF)


@query("prolong_trilinear", with_grid(f"SELECT CAST((2 * x + dx + 32) % 32 AS INTEGER) AS x, CAST((2 * y + dy + 32) % 32 AS INTEGER) AS y, CAST((2 * z + dz + 32) % 32 AS INTEGER) AS z, sum(f * CAST(c AS DOUBLE)) AS f FROM grid, (VALUES {_PRO}) AS taps(dx, dy, dz, c) GROUP BY 1, 2, 3"))
def prolong_trilinear(spark, sf_dir):
    return transfer.prolong(line_grid(spark, sf_dir), GridSpec((32, 32, 32)), ("f",))


_WE = {-1: 0.125, 0: 0.375, 1: 0.375, 2: 0.125}
_REST_EVEN = S.Stencil.of({(i, j, k): _WE[i] * _WE[j] * _WE[k] for i in _WE for j in _WE for k in _WE})
_HALF_EVEN = {-1: 0.25, 0: 0.75, 1: 0.75, 2: 0.25}
_PRO_EVEN = ", ".join(f"({i}, {j}, {k}, {_HALF_EVEN[i] * _HALF_EVEN[j] * _HALF_EVEN[k]!r})" for i in _HALF_EVEN for j in _HALF_EVEN for k in _HALF_EVEN)


@query("restrict_even", with_grid(f"SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, v AS f FROM ({taps_sql({'v': (_REST_EVEN, 'f')})}) WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0"))
def restrict_even(spark, sf_dir):
    return transfer.restrict(line_grid(spark, sf_dir), LINES, ("f",), even=True)


@query("prolong_even", with_grid(f"SELECT CAST((2 * x + dx + 32) % 32 AS INTEGER) AS x, CAST((2 * y + dy + 32) % 32 AS INTEGER) AS y, CAST((2 * z + dz + 32) % 32 AS INTEGER) AS z, sum(f * CAST(c AS DOUBLE)) AS f FROM grid, (VALUES {_PRO_EVEN}) AS taps(dx, dy, dz, c) GROUP BY 1, 2, 3"))
def prolong_even(spark, sf_dir):
    return transfer.prolong(line_grid(spark, sf_dir), GridSpec((32, 32, 32)), ("f",), even=True)


@query("jacobi_sweep", with_grid(f"SELECT x, y, z, f + 1.0 * ((g - n) / -6.0 - f) AS f, g FROM ({taps_sql({'n': (S.Stencil.of({t: c for t, c in S.laplace(2).taps if any(t)}), 'f')}, ('g', 'f'))})"))
def jacobi_sweep(spark, sf_dir):
    return solvers.jacobi(line_grid(spark, sf_dir).select(*AXES, "f", "g"), LINES, S.laplace(2), "f", "g")


def _centred(spark, sf_dir):
    g = line_grid(spark, sf_dir)
    mean = g.agg(F.avg("f")).first()[0]
    return g.select(*AXES, F.lit(0.0).alias("u"), (F.col("f") - mean).alias("b"))


_AROUND = S.Stencil.of({t: c for t, c in S.laplace(2).taps if any(t)})
_SOR = "(SELECT x, y, z, CAST(0 AS DOUBLE) AS u, f - (SELECT avg(f) FROM grid) AS b FROM grid)"
for _colour in (0, 1, 0, 1):
    _SOR = f"(SELECT x, y, z, CASE WHEN (x + y + z) % 2 = {_colour} THEN u + 1.5 * ((b - n) / -6.0 - u) ELSE u END AS u, b FROM ({taps_sql({'n': (_AROUND, 'u')}, ('u', 'b'), source=_SOR)}))"
rounded_query("red_black_sor", _SOR, lambda spark, sf_dir: solvers.red_black(_centred(spark, sf_dir), LINES, S.laplace(2), "u", "b", 2, 1.5), ("u", "b"))
#: Residual norm in parts of the right side's norm at which the Krylov solvers end.
RELATIVE = 1e-6


def _krylov(solve, op):
    def run(spark, sf_dir):
        found = solve(_centred(spark, sf_dir), LINES, op, "u", "b", 0.0, relative=RELATIVE)
        return solvers.solved(found, LINES, op, "u", "b", RELATIVE)

    return run


QUERIES["conjugate_gradients"] = _krylov(solvers.cg, S.laplace(2).scaled(-1))
QUERIES["bicgstab"] = _krylov(solvers.bicgstab, S.laplace(2))
QUERIES["multigrid_v_cycle"] = lambda spark, sf_dir: solvers.v_cycle(_centred(spark, sf_dir), LINES, "u", "b", 1, 1, 512)
_PI = 3.141592653589793


def _dft_sql(source: str, axes: tuple[int, ...], inverse: bool = False, re: str = "f", im: str = "CAST(0 AS DOUBLE)") -> str:
    """A transform as one axis after the other, each a sum over the line; forward divided by the length of the line."""
    out = f"(SELECT x, y, z, {re} AS re, {im} AS im FROM {source})"
    for a in axes:
        at = ", ".join(f"CAST(k AS INTEGER) AS {n}" if i == a else n for i, n in enumerate(AXES))
        turn = f"{2 * _PI / SIDE!r} * ((k * {AXES[a]}) % {SIDE})"
        sign, by = (1, "") if inverse else (-1, f" / {float(SIDE)}")
        out = f"(SELECT {at}, sum(re * cos({turn}) - ({sign}) * im * sin({turn})){by} AS re, sum(im * cos({turn}) + ({sign}) * re * sin({turn})){by} AS im FROM {out}, (SELECT range AS k FROM range({SIDE})) GROUP BY {', '.join('k' if i == a else n for i, n in enumerate(AXES))})"
    return out


_waves = lambda spark, sf_dir, axes=(0, 1, 2): spectral.forward(line_grid(spark, sf_dir), LINES, "f", axes)
rounded_query("fft_forward", _dft_sql("grid", (0, 1, 2)), _waves, ("re", "im"))
rounded_query("fft_half_spectrum", f"SELECT * FROM {_dft_sql('grid', (0, 1, 2))} WHERE x <= {SIDE // 2}", lambda spark, sf_dir: spectral.half(_waves(spark, sf_dir), LINES), ("re", "im"))
rounded_query("fft_planar", _dft_sql("grid", (0, 1)), lambda spark, sf_dir: _waves(spark, sf_dir, (0, 1)), ("re", "im"))


@query("fft_round_trip", with_grid("SELECT x, y, z, f FROM grid"))
def fft_round_trip(spark, sf_dir):
    d = spectral.backward(spectral.forward(line_grid(spark, sf_dir), LINES, "f"), LINES, "f")
    return d.select(*AXES, (F.round("f", 6) + 0.0).alias("f"))


_K = {a: f"({2 * _PI / SIDE!r} * (CASE WHEN {a} * 2 <= {SIDE} THEN {a} ELSE {a} - {SIDE} END))" for a in AXES}
_K2 = " + ".join(f"{_K[a]} * {_K[a]}" for a in AXES)


def _wave_sql(by: str, out: str, axes: tuple[int, ...] = (0, 1, 2), source: str = "grid") -> str:
    scaled = f"(SELECT x, y, z, re * ({by}) AS re, im * ({by}) AS im FROM {_dft_sql(source, axes)})"
    return f"SELECT x, y, z, re AS {out} FROM {_dft_sql(scaled, axes, True, 're', 'im')}"


rounded_query("poisson_in_wave_space", _wave_sql(f"CASE WHEN x = 0 AND y = 0 AND z = 0 THEN 0.0 ELSE -1 / ({_K2}) END", "u"), lambda spark, sf_dir: spectral.poisson(line_grid(spark, sf_dir), LINES, "f", "u"), ("u",))
rounded_query("diffusion_in_wave_space", _wave_sql(f"exp(-0.05 * ({_K2}))", "f"), lambda spark, sf_dir: spectral.diffuse(line_grid(spark, sf_dir), LINES, "f", 0.1, 0.5, "f"), ("f",))


def _diffusion(spec):
    return lambda g, t: S.apply(g, spec, {"d_f": (S.laplace(6), "f")}, tuple(c for c in g.columns if c not in AXES))


def _low_storage_sql(source: str, order: int, dt: float) -> str:
    out = f"(SELECT x, y, z, f, CAST(0 AS DOUBLE) AS w FROM {source})"
    for alpha, beta in zip(*integrate.LOW_STORAGE[order]):
        w = f"({alpha!r} * w + {dt!r} * d / 180.0)"
        out = f"(SELECT x, y, z, f + {beta!r} * {w} AS f, {w} AS w FROM ({taps_sql({'d': (whole(S.laplace(6), 180), 'f')}, ('f', 'w'), source=out)}))"
    return out


_RKF4 = "(SELECT x, y, z, f, f AS s FROM grid)"
for _al, _be in zip(integrate.RKF4_ALPHA, integrate.RKF4_BETA):
    _RKF4 = f"(SELECT x, y, z, s + {_al!r} * (0.05 * d / 180.0) AS f, s + {_be!r} * (0.05 * d / 180.0) AS s FROM ({taps_sql({'d': (whole(S.laplace(6), 180), 'f')}, ('f', 's'), source=_RKF4)}))"
rounded_query("runge_kutta_3_step", _low_storage_sql("grid", 3, 0.05), lambda spark, sf_dir: integrate.step(line_grid(spark, sf_dir), ("f",), _diffusion(LINES), 0.0, 0.05), ("f",))
rounded_query("runge_kutta_4_step", f"SELECT x, y, z, s AS f FROM {_RKF4}", lambda spark, sf_dir: integrate.rkf4(line_grid(spark, sf_dir), ("f",), _diffusion(LINES), 0.0, 0.05)[0], ("f",))


@query("time_step_limit", with_grid("SELECT 0.4 * 1.0 / (max(sqrt(f * f + g * g + h * h) + 0.0)) AS dt FROM grid"))
def time_step_limit(spark, sf_dir):
    dt = integrate.time_step(line_grid(spark, sf_dir), LINES, V)
    return spark.range(1).select(F.lit(dt).alias("dt"))


@query("diagnostics_row", with_grid("SELECT CAST(3 AS INTEGER) AS step, CAST(0.5 AS DOUBLE) AS t, min(f) AS f_min, sqrt(sum(f * f) / 4096) AS f_rms, max(f) AS f_max FROM grid"))
def diagnostics_row(spark, sf_dir):
    return integrate.diagnostics(line_grid(spark, sf_dir), LINES, ("f",), 3, 0.5)


_BALL = GridSpec((SIDE, SIDE, SIDE), length=(1.5, 1.2, 6.283185307179586), periodic=(False, False, True), origin=(0.5, 0.9, 0.0))


@query("sink_accretion", with_grid(f"SELECT round(sum(f * greatest(0.0, -(g - 20)) * 0.25 * sin(0.9 + y * {_BALL.spacing[1]!r}) * {_BALL.spacing[1] * _BALL.spacing[2]!r}), 6) AS rate FROM grid WHERE x = 0"))
def sink_accretion(spark, sf_dir):
    d = line_grid(spark, sf_dir).withColumn("ur", F.col("g") - 20).agg(integrate.sink_accretion(_BALL, "f", "ur").alias("rate"))
    return d.select(F.round("rate", 6).alias("rate"))


_CUBE = GridSpec((16, 16, 16), length=(6.283185307179586,) * 3)
QUERIES["helical_forcing"] = lambda spark, sf_dir: _CUBE.keys(spark).select(*AXES, *(c.alias(k) for k, c in zip(("fx", "fy", "fz"), integrate.Helical((1.0, 2.0, 0.0)).columns(_CUBE))))
QUERIES["initial_conditions"] = lambda spark, sf_dir: _CUBE.keys(spark).select(*AXES, *(integrate.initial(_CUBE, k, 3)["f"].alias(k) for k in ("zero", "constant", "random", "gaussian", "sine", "shell")), *(c.alias(f"abc_{k}") for k, c in integrate.initial(_CUBE, "abc").items()))
QUERIES["random_walk"] = lambda spark, sf_dir: integrate.walk(spark.range(1000).select("id", *(F.lit(1.0).alias(f"p{a}") for a in AXES)), _CUBE, 5)
QUERIES["spherical_harmonic_moments"] = lambda spark, sf_dir: harmonics.moments(line_grid(spark, sf_dir), LINES, "f", 3)


def magnetohydrodynamics(spark, sf_dir):
    """Right-hand side of all equations, from fields made of the grid's."""
    fluid = integrate.Fluid(forcing=integrate.Helical((1.0, 0.0, 0.0)))
    g = line_grid(spark, sf_dir)
    source = dict(zip(fluid.fields, ("f", "g", "h", "w", "f", "g", "h", "w")))
    return fluid.rhs(_CUBE)(g.select(*AXES, *((F.col(c) / 1000).alias(k) for k, c in source.items())), 0.0)


QUERIES["magnetohydrodynamics_rhs"] = magnetohydrodynamics


@query("steps_smooth_then_centre", with_grid(f"SELECT x, y, z, s - m AS s FROM (SELECT x, y, z, s / 64.0 AS s FROM ({taps_sql({'s': (whole(S.binomial(1), 64), 'f')})})), (SELECT max(s) / 64.0 AS m FROM ({taps_sql({'s': (whole(S.binomial(1), 64), 'f')})}))"))
def steps_smooth_then_centre(spark, sf_dir):
    smooth = Kernel(lambda g, spec: S.apply(g, spec, {"s": (whole(S.binomial(1), 64), "f")}).withColumn("s", F.col("s") / 64.0))
    centre = Kernel(lambda g, spec, m: g.withColumn("s", F.col("s") - F.lit(m)))
    return Steps(LINES).call(smooth).reduce(most=F.max("s")).call(centre, m="most").run(line_grid(spark, sf_dir))


_EVENTS = """WITH b AS (
  SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bin, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS v FROM events GROUP BY 1
), k AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin, min(bin) AS lo FROM b), g AS (
  SELECT CAST(k.bin - lo AS INTEGER) AS x, coalesce(v, 0) AS v FROM k LEFT JOIN b USING (bin)
)"""


@query("event_line_smooth", _EVENTS + " SELECT x, (coalesce(lag(v) OVER w, 0) + 2 * v + coalesce(lead(v) OVER w, 0)) / 4.0 AS smooth, sum(v) OVER w AS total FROM g WINDOW w AS (ORDER BY x)")
def event_line_smooth(spark, sf_dir):
    grid, spec = event_grid(spark, sf_dir)
    d = S.apply(grid, spec, {"s": (whole(S.binomial(1, (0,)), 4), "v")}, ("v",))
    return d.select("x", (F.col("s") / 4.0).alias("smooth"), ray.running(F.col("v"), (1, 0, 0)).alias("total"))


_T = "(f - 400) / 400"


@query("intrinsics", with_grid(f"SELECT x, y, z, round(sin({_T}), 9) + 0.0 AS sin_, round(cos({_T}), 9) + 0.0 AS cos_, round(atan2({_T}, 2.0), 9) + 0.0 AS atan2_, round(exp({_T}), 9) + 0.0 AS exp_, round(pow(2.0, {_T}), 9) + 0.0 AS pow_, sqrt(g) AS sqrt_, floor(f / 8) AS floor_, ceil(f / 8) AS ceil_, least(f, h) AS least_, greatest(f, h) AS greatest_, abs(h - 40) AS abs_ FROM grid"))
def intrinsics(spark, sf_dir):
    t, f, g, h = (F.col("f") - 400) / 400, F.col("f"), F.col("g"), F.col("h")
    r = lambda c: F.round(c, 9) + 0.0
    return line_grid(spark, sf_dir).select(
        *AXES, r(F.sin(t)).alias("sin_"), r(F.cos(t)).alias("cos_"), r(F.atan2(t, F.lit(2.0))).alias("atan2_"), r(F.exp(t)).alias("exp_"), r(F.pow(F.lit(2.0), t)).alias("pow_"), F.sqrt(g).alias("sqrt_"),
        F.floor(f / 8).cast("double").alias("floor_"), F.ceil(f / 8).cast("double").alias("ceil_"), F.least(f, h).alias("least_"), F.greatest(f, h).alias("greatest_"), F.abs(h - 40).alias("abs_"))


@query("vector_and_matrix_algebra", with_grid("SELECT x, y, z, f*g + g*h + h*w AS dot_, g*w - h*h AS cross_x, h*g - f*w AS cross_y, f*h - g*g AS cross_z, f*(g*h - w*w) - g*(g*h - f*w) + h*(g*w - f*g) AS det_, f + g + h AS trace_ FROM grid"))
def vector_and_matrix_algebra(spark, sf_dir):
    from ..functions import algebra as A

    f, g, h, w = map(F.col, "fghw")
    a, b = [f, g, h], [g, h, w]
    c = A.cross(a, b)
    m = [[f, g, h], [g, g, w], [f, w, h]]
    return line_grid(spark, sf_dir).select(*AXES, A.dot(a, b).alias("dot_"), *(v.alias(f"cross_{k}") for k, v in zip(AXES, c)), A.determinant(m).alias("det_"), A.trace(m).alias("trace_"))


@query("complex_arithmetic", with_grid("SELECT x, y, z, f*h - g*w AS re_, f*w + g*h AS im_, sqrt(f*f + g*g) AS abs_ FROM grid"))
def complex_arithmetic(spark, sf_dir):
    from ..functions.algebra import Complex

    p, q = Complex(F.col("f"), F.col("g")), Complex(F.col("h"), F.col("w"))
    return line_grid(spark, sf_dir).select(*AXES, (p * q).re.alias("re_"), (p * q).im.alias("im_"), p.abs().alias("abs_"))


@query("lookup_table", with_grid(f"SELECT x, y, z, f * (1 + x % 4) AS f FROM grid WHERE x + y < {SIDE}"))
def lookup_table(spark, sf_dir):
    table = F.array(*(F.lit(float(k + 1)) for k in range(4)))
    return line_grid(spark, sf_dir).where(F.col("x") + F.col("y") < SIDE).select(*AXES, (F.col("f") * F.element_at(table, F.col("x") % 4 + 1)).alias("f"))


_SD = {f"d{o}{a}": (S.central(i, o, 6), "f") for o in (1, 2) for i, a in enumerate(AXES)}
_R, _TH = "(x + 1.0)", "((y + 1.0) / 20)"
rounded_query("spherical_derivatives", f"SELECT x, y, z, d1x AS grad_r, d1y / {_R} AS grad_theta, d1z / ({_R} * sin({_TH})) AS grad_phi, d2x + 2 * d1x / {_R} + (d2y + cos({_TH}) / sin({_TH}) * d1y) / ({_R} * {_R}) + d2z / ({_R} * sin({_TH}) * {_R} * sin({_TH})) AS laplace FROM ({taps_sql(_SD)})", _plain(lambda d: C.spherical(d, "f", F.col("x") + 1.0, (F.col("y") + 1.0) / 20)), ("grad_r", "grad_theta", "grad_phi", "laplace"), 5)
rounded_query("cylindrical_derivatives", f"SELECT x, y, z, d1x AS grad_r, d1y / {_R} AS grad_phi, d1z AS grad_z, d2x + d1x / {_R} + d2y / ({_R} * {_R}) + d2z AS laplace FROM ({taps_sql(_SD)})", _plain(lambda d: C.cylindrical(d, "f", F.col("x") + 1.0)), ("grad_r", "grad_phi", "grad_z", "laplace"), 5)
rounded_query("spherical_divergence_and_curl", f"SELECT x, y, z, fx + 2 * f / {_R} + (gy + cos({_TH}) / sin({_TH}) * g) / {_R} + hz / ({_R} * sin({_TH})) AS div, (hy + cos({_TH}) / sin({_TH}) * h) / {_R} - gz / ({_R} * sin({_TH})) AS curl_r, fz / ({_R} * sin({_TH})) - h / {_R} - hx AS curl_theta, gx + g / {_R} - fy / {_R} AS curl_phi FROM ({taps_sql(_D1, V)})", _plain(lambda d: C.spherical_vector(d, V, F.col("x") + 1.0, (F.col("y") + 1.0) / 20), V), ("div", "curl_r", "curl_theta", "curl_phi"), 5)
_ST = "(1 / (1 + 0.1 * z))"
rounded_query("stretched_axis", f"SELECT x, y, z, d1z * {_ST} AS first, d2z * {_ST} * {_ST} + d1z * (-0.1 / pow(1 + 0.1 * z, 3)) AS second FROM ({taps_sql(_SD)})", _plain(lambda d: dict(zip(("first", "second"), C.stretched(d, "f", 2, 1 / (1 + 0.1 * F.col("z")), -0.1 / (1 + 0.1 * F.col("z")) ** 3)))), ("first", "second"))
rounded_query("potential_field", _wave_sql(f"exp(-1.5 * sqrt({_K['x']} * {_K['x']} + {_K['y']} * {_K['y']}))", "f", (0, 1), "(SELECT * FROM grid WHERE z = 0)"), lambda spark, sf_dir: spectral.potential(R.band(line_grid(spark, sf_dir), z=(0, 1)), LINES, "f", 1.5, "f"), ("f",))
QUERIES["multipole_potential"] = lambda spark, sf_dir: harmonics.potential(line_grid(spark, sf_dir), LINES, harmonics.moments(line_grid(spark, sf_dir), LINES, "f", 2), 2, "u").select(*AXES, "u")
rounded_query("diffusion_time_loop", _low_storage_sql(_low_storage_sql("grid", 2, 0.05), 2, 0.05), lambda spark, sf_dir: integrate.run(line_grid(spark, sf_dir), ("f",), _diffusion(LINES), 2, 0.05, 2)[0], ("f",))


def _moving(spark, sf_dir):
    """Cells moved by up to a fifth of the spacing, by their own fields."""
    from ..operators.moving import average_gradient

    g = line_grid(spark, sf_dir)
    for a, f in zip(AXES, V):
        g = g.withColumn(f"p{a}", F.col(a) + (F.col(f) % 7 - 3) / 15)
    return average_gradient(g, LINES, {k: f"p{a}" for k, a in enumerate(AXES)}, "w")


QUERIES["moving_grid_gradient"] = _moving


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem on a grid, its sixth-order Laplacian, reduced by planes."""
    return R.profile(QUERIES["laplace_order_6"](spark, sf_dir), "z", {"sum_lap": F.sum("lap"), "min_lap": F.min("lap"), "max_lap": F.max("lap")})
