"""Operators on small grids against numpy."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.functions import algebra, scalar
from trellis.operators import boundary, calculus, harmonics, integrate, ray, reduce, solvers, spectral, transfer
from trellis.operators import stencil as S
from trellis.plans.steps import KERNELS, Kernel, Steps, kernel, windowed
from trellis.sources import mesh
from trellis.spec import AXES, GridSpec

SPEC = GridSpec((12, 10, 8))


def field(seed=0, n=SPEC.n):
    return np.random.default_rng(seed).normal(size=n)


def grid(spark, **fields):
    a = next(iter(fields.values()))
    keys = np.indices(a.shape).reshape(3, -1)
    rows = [(*map(int, k), *map(float, v)) for k, v in zip(keys.T, np.array([f.ravel() for f in fields.values()]).T)]
    return spark.createDataFrame(rows, "x int, y int, z int" + "".join(f", {k} double" for k in fields))


def array(df, name, n=SPEC.n, start=(0, 0, 0)):
    p = df.toPandas()
    out = np.full(n, np.nan)
    out[tuple(p[a].to_numpy() - s for a, s in zip(AXES, start))] = p[name].to_numpy()
    return out


def close(a, b, tolerance=1e-9):
    assert np.allclose(a, b, rtol=tolerance, atol=tolerance), np.nanmax(np.abs(a - b))


STENCILS = {
    "d1": S.central(0, 1, 6), "d2": S.central(1, 2, 8), "d5": S.central(2, 5, 6), "mixed": S.mixed(0, 2), "cross": S.crossed((4, 2, 0), 2),
    "up": S.upwind(1, -1), "one": S.one_sided(0, 1), "lap": S.laplace(6), "avg": S.average(), "bin": S.binomial(1), "max": S.local_max(1), "gauss": S.gaussian(2),
}


@pytest.mark.parametrize("strategy", ["scatter", "blocks"])
def test_stencils(spark, strategy):
    a = field()
    got = S.apply(grid(spark, f=a), SPEC, {k: (s, "f") for k, s in STENCILS.items()}, ("f",), strategy).persist()
    assert got.count() == SPEC.cells
    for k, s in STENCILS.items():
        close(array(got, k), s.numpy(a))
    close(array(got, "f"), a)


@pytest.mark.parametrize("periodic", [(True, True, True), (False, True, False)])
def test_strategies_agree(spark, periodic):
    """Missing rows, nulls, NaN, kept integers and strings: boxes and scattering give the same rows and types."""
    spec = GridSpec((35, 4, 3), periodic=periodic)
    rng = np.random.default_rng(13)
    rows = []
    for p in product(*map(range, spec.n)):
        kind = rng.integers(0, 12)
        if kind:  # else the row is missing
            rows.append((*p, None if kind == 1 else float("nan") if kind == 2 else float(rng.integers(0, 50)), int(rng.integers(0, 9)) if kind != 3 else None, f"s{kind}"))
    g = spark.createDataFrame(rows, "x int, y int, z int, f double, i int, s string")
    asked = {"avg": (S.box(1).scaled(27), "f"), "one": (S.central(0, 1, 2).scaled(2), "f"), "most": (S.local_max(1), "f"), "ints": (S.laplace(2), "i"), "far": (S.central(0, 1, 6).scaled(60), "i")}
    a, b = (S.apply(g, spec, asked, ("i", "s"), k) for k in ("scatter", "blocks"))
    assert a.dtypes == b.dtypes and dict(b.dtypes)["s"] == "string" and dict(b.dtypes)["i"] == "int"
    cut = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    a, b = (sorted((tuple(map(cut, r)) for r in d.collect()), key=repr) for d in (a, b))
    assert list(map(repr, a)) == list(map(repr, b)) and len(a) > len(rows)


def test_nan_goes_on_and_gaps_do_not(spark):
    spec = GridSpec((8, 1, 1), periodic=(False, False, False))
    g = spark.createDataFrame([(x, 0, 0, float("nan") if x == 3 else 1.0) for x in range(8) if x != 6], "x int, y int, z int, f double")
    for k in ("scatter", "blocks"):
        got = {r.x: (r.s, r.m) for r in S.apply(g, spec, {"s": (S.box(1, axes=(0,)).scaled(3), "f"), "m": (S.box(1, op="max", axes=(0,)), "f")}, (), k).collect()}
        assert all(np.isnan(got[x]).all() for x in (2, 3, 4)) and got[0] == (pytest.approx(2), 1) and got[6] == (pytest.approx(2), 1) and got[7] == (pytest.approx(1), 1)


def test_smoothing_weights():
    for radius, ratio in ((3, np.exp(-1 / 4)), (5, np.exp(-1 / 8))):
        taps = dict(S.gaussian(radius).taps)
        assert taps[1, 0, 0] / taps[0, 0, 0] == pytest.approx(ratio)
    assert dict(S.smooth(6).taps)[3, 3, 3] == pytest.approx(180.0**-3) and dict(S.smooth(2).taps)[0, 0, 0] == pytest.approx((14 / 32) ** 3)
    ball = dict(S.ball(3).taps)
    assert (2, 2, 1) in ball and (3, 0, 0) in ball and (2, 2, 2) not in ball and (3, 1, 0) not in ball


def test_blocks_with_several_boxes(spark):
    spec = GridSpec((40, 5, 37), periodic=(True, True, False))
    a = field(3, spec.n)
    s = S.central(0, 1, 6) + S.central(2, 2, 4)
    close(array(S._blocks(grid(spark, f=a), spec, {"v": (s, "f")}, ()), "v", spec.n), array(S._scatter(grid(spark, f=a), spec, {"v": (s, "f")}, ()), "v", spec.n))


def test_finite_differences_are_exact_on_polynomials():
    for order, accuracy in product((1, 2, 3, 4, 5, 6), (2, 4, 6, 8)):
        s = S.central(0, order, accuracy)
        for p in range(order + 1):
            want = float(np.prod(range(1, order + 1))) if p == order else 0.0
            assert sum(c * t[0] ** p for t, c in s.taps) == pytest.approx(want, abs=1e-9)
    assert dict(S.central(0, 2, 6).taps)[(0, 0, 0)] == pytest.approx(-49 / 18)
    assert sum(c for _, c in S.gaussian(3).taps) == pytest.approx(1)
    assert dict(S.mixed(0, 1).taps)[(1, 1, 0)] == pytest.approx(270 / 720)


@pytest.mark.parametrize("accuracy,power", [(4, 4), (6, 6)])
def test_compact_poisson_order(accuracy, power):
    left, right = S.mehrstellen(accuracy)
    errors = []
    for h in (0.2, 0.1):
        u = lambda t: np.sin(1.1 * t[0] * h + 0.3) * np.cos(0.7 * t[1] * h) * np.exp(0.4 * t[2] * h)
        lam = -(1.1**2) - 0.7**2 + 0.4**2
        errors.append(abs(sum(c * u(t) for t, c in left.taps) / h**2 - lam * sum(c * u(t) for t, c in right.taps)))
    assert errors[0] / errors[1] > 2**power * 0.8


def test_calculus(spark):
    n = 24
    spec = GridSpec((n, n, 1), length=(2 * np.pi,) * 3)
    i, j, _ = np.indices(spec.n) * 2 * np.pi / n
    g = grid(spark, a=np.sin(i) * np.cos(j), b=np.cos(2 * i), c=np.sin(j))
    v = ("a", "b", "c")

    def build(d):
        return {"div": calculus.divergence(d, v), "curl_z": calculus.curl(d, v)[2], "lap": calculus.laplace(d, "a"), "hxy": calculus.hessian(d, "a")[0][1], "bi": calculus.biharmonic(d, "a"),
                "cc": calculus.curl_of_curl(d, v)[0], "adv": calculus.u_dot_grad(d, v, "a"), "trace": algebra.trace(calculus.traceless_strain(d, v)), "up": calculus.u_dot_grad_upwind(d, v, "a")}

    got = calculus.select(g, spec, build, v).persist()
    want = {"div": np.cos(i) * np.cos(j), "curl_z": -2 * np.sin(2 * i) + np.sin(i) * np.sin(j), "lap": -2 * np.sin(i) * np.cos(j), "hxy": -np.cos(i) * np.sin(j), "bi": 4 * np.sin(i) * np.cos(j),
            "cc": -np.sin(i) * np.cos(j) + 2 * np.sin(i) * np.cos(j), "adv": np.sin(i) * np.cos(i) * np.cos(j) ** 2 - np.cos(2 * i) * np.sin(i) * np.sin(j), "trace": 0 * i}
    for k, w in want.items():
        close(array(got, k, spec.n), w, 2e-3)
    close(array(got, "up", spec.n), want["adv"], 1e-2)
    close(array(calculus.shock(g, spec, v), "shock", spec.n).min(), 0, 1)
    close(array(calculus.slope_limited_diffusion(g, spec, "a", "c"), "diffusion", spec.n).sum(), 0, 1e-9)
    flat = array(calculus.slope_limited_diffusion(grid(spark, a=0 * i + 1, c=0 * i + 1), spec, "a", "c", ln_field=True), "diffusion", spec.n)
    close(flat, 0)


def test_boundaries(spark):
    spec = GridSpec((9, 3, 2), periodic=(False, False, False))
    a = field(5, spec.n)
    ghost = lambda kind, v=0.0: array(boundary.extend(grid(spark, f=a), spec, {"f": boundary.Condition(kind, v)}, 0, 3), "f", (15, 3, 2), (-3, 0, 0))
    low, high, e0, e1 = a[[3, 2, 1]], a[[7, 6, 5]], a[0], a[8]
    for kind, lo, hi in (("symmetric", low, high), ("relative", 2 * e0 - low, 2 * e1 - high), ("constant", 0 * low + 4, 0 * high + 4), ("outflow", np.where(-e0 > 0, low, -low), np.where(e1 > 0, high, -high))):
        got = ghost(kind, 4.0)
        close(got[:3], lo)
        close(got[12:], hi)
        close(got[3:12], a)
    got = ghost("derivative", 2.0)
    close(got[12:], high + np.array([4, 8, 12])[:, None, None])
    got = ghost("antisymmetric")
    close(got[[3, 11]], 0)
    p = np.arange(9.0)[:, None, None] ** 4 + a[:1] * 0
    close(array(boundary.extend(grid(spark, f=p), spec, {"f": boundary.Condition("one_sided")}, 0, 3), "f", (15, 3, 2), (-3, 0, 0))[:, 0, 0], np.arange(-3.0, 12) ** 4, 1e-6)
    wrapped = array(boundary.surround(grid(spark, f=a), GridSpec(spec.n), {"f": boundary.Condition("periodic")}, 1), "f", (11, 5, 4), (-1, -1, -1))
    close(wrapped, np.pad(a, 1, mode="wrap"))
    closed = array(boundary.surround(grid(spark, f=a), spec, {"f": boundary.Condition("symmetric")}, 1), "f", (11, 5, 4), (-1, -1, -1))
    close(closed, np.pad(a, 1, mode="reflect"))
    with pytest.raises(ValueError):
        boundary.extend(grid(spark, f=a), spec, {"f": boundary.Condition("symmetric")}, 1, 3)
    moved = array(boundary.shear_shift(grid(spark, f=field(1)), SPEC, "f", 2.0, 1), "f", (14, 10, 8), (-1, 0, 0))
    close(moved[0], np.roll(field(1)[-1], -2, 0), 1e-9)
    close(moved[13], np.roll(field(1)[0], 2, 0), 1e-9)


def test_reductions(spark):
    a, b, c = field(1), field(2), field(3)
    g = grid(spark, a=a, b=b, c=c)
    v = ("a", "b", "c")
    r = reduce.scalars(g, SPEC, {k: (k, v if k.startswith("rms") else ("a", "b", "c", "a") if k.startswith("alfven") else "a", *([3.0] if "radial" in k or "gaussian" in k else [])) for k in reduce.REDUCTIONS}).first()
    sq = a * a + b * b + c * c
    d = np.sqrt(sum((i - (n - 1) / 2) ** 2 for i, n in zip(np.indices(SPEC.n), SPEC.n)))
    want = {"max": a.max(), "sum": a.sum(), "rms": np.sqrt(sq.mean()), "alfven_max": np.sqrt(sq / np.exp(a)).max(), "radial_sum": (a * (d <= 3)).sum(), "gaussian_sum": (a * np.exp(-((d / 3) ** 2))).sum(),
            "radial_min": (a * (d <= 3)).min(), "rms_exp": np.sqrt((np.exp(2 * a) + np.exp(2 * b) + np.exp(2 * c)).mean())}
    for k, w in want.items():
        close(r[k], w)
    close(sum(x.s for x in reduce.profile(g, "yz", {"s": F.sum("a")}).collect()), a.sum())
    assert reduce.profiles(g, {"s": F.sum("a")}).count() == 1 + 12 + 10 + 8 + 120 + 96 + 80
    with pytest.raises(ValueError):
        reduce.profile(g, "xyz", {})


@pytest.mark.parametrize("name", ["ppp", "mpz", "zzm", "left"])
def test_rays(spark, name):
    d = ray.DIRECTIONS[name]
    a = field(4)
    got = array(grid(spark, f=a).select(*AXES, ray.running(F.col("f"), d).alias("s")), "s")
    half = array(ray.recurrence(grid(spark, f=a), d, F.lit(0.9), F.col("f"), "q", 2.0), "q")
    for p in product(*map(range, SPEC.n)):
        before = tuple(i - k for i, k in zip(p, d))
        inside = all(0 <= i < n for i, n in zip(before, SPEC.n))
        close(got[p], a[p] + (got[before] if inside else 0))
        close(half[p], a[p] + 0.9 * (half[before] if inside else 2.0))
    assert len({d for d in ray.DIRECTIONS.values()}) == 26


def test_closed_ray(spark):
    a = field(6)
    for factor in (0.7, -0.4, 0.0):
        q = array(ray.closed(grid(spark, a=0 * a + factor, b=a), 0, 1, "a", "b", "q"), "q")
        close(q, factor * np.roll(q, 1, 0) + a)


def test_long_lines(spark):
    n = 20_000
    d = spark.range(n).select(F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.lit(1.0).alias("f"))
    got = ray.recurrence(d, (1, 0, 0), F.lit(1.0), F.col("f"), "q").agg(F.max("q"), F.sum("q")).first()
    assert tuple(got) == (n, n * (n + 1) / 2)


def test_radiation(spark):
    """Constant source: nothing but what comes in, weakened; a linear one: its slope, which second order gets exactly."""
    spec = GridSpec((1, 1, 40), periodic=(False, False, False))
    k = np.arange(40.0).reshape(spec.n)
    for chi in (1e-7, 0.3, 900.0):
        flat = array(ray.radiation(grid(spark, c=0 * k + chi, s=0 * k + 5), spec, (0, 0, 1), "c", "s", "q", 2.0), "q", spec.n)
        close(flat, 2 * np.exp(-chi * (k + 1)))
    line = array(ray.radiation(grid(spark, c=0 * k + 0.3, s=3 * k), spec, (0, 0, 1), "c", "s", "q", -10.0), "q", spec.n)
    e = np.exp(-0.3)
    close(line[0, 0, 2:38], line[0, 0, 1:37] * e - 10.0 * (1 - e))


def test_transfer(spark):
    spec = GridSpec((8, 8, 8))
    one = grid(spark, f=np.ones(spec.n))
    for even in (False, True):
        close(array(transfer.restrict(one, spec, ("f",), even), "f", (4, 4, 4)), 1)
        close(array(transfer.prolong(grid(spark, f=np.ones((4, 4, 4))), spec, ("f",), even), "f", (8, 8, 8)), 1)
    a = field(7, (4, 4, 4))
    fine = array(transfer.prolong(grid(spark, f=a), spec, ("f",)), "f", (8, 8, 8))
    close(fine[::2, ::2, ::2], a)
    close(fine[1::2, ::2, ::2], (a + np.roll(a, -1, 0)) / 2)


def test_spectral(spark):
    a = field(8)
    spec = GridSpec(SPEC.n, length=(2 * np.pi,) * 3)
    s = spectral.forward(grid(spark, f=a), spec, "f").persist()
    want = np.fft.fftn(a) / a.size
    close(array(s, "re"), want.real)
    close(array(s, "im"), want.imag)
    close(array(spectral.backward(s, spec, "f"), "f"), a)
    close(array(spectral.whole(spectral.half(s, spec), spec), "im"), want.imag)
    close(array(spectral.backward(spectral.shifted(s, spec, 0, 2 * spec.spacing[0]), spec, "f"), "f").mean(), a.mean())
    i = np.indices(spec.n)[1] * spec.spacing[1]
    close(array(spectral.poisson(grid(spark, f=np.sin(2 * i)), spec, "f", "u"), "u"), -np.sin(2 * i) / 4)
    close(array(spectral.diffuse(grid(spark, f=np.sin(2 * i)), spec, "f", 0.5, 0.3, "u"), "u"), np.sin(2 * i) * np.exp(-0.6))


def test_solvers(spark):
    spec = GridSpec((8, 8, 4))
    u = field(9, spec.n)
    u -= u.mean()
    op = S.laplace(2)
    g = grid(spark, u=0 * u, b=op.numpy(u))
    got, rounds, norm = solvers.cg(g, spec, op.scaled(1), "u", "b", 1e-8, 60)
    assert norm <= 1e-8
    close(array(got, "u", spec.n), u, 1e-7)
    skew = op.scaled(-1) + S.central(0, 1, 2) + S.Stencil.of({(0, 0, 0): 1.0})
    got, rounds, norm = solvers.bicgstab(grid(spark, u=0 * u, b=skew.numpy(u)), spec, skew, "u", "b", 1e-8, 40)
    assert norm <= 1e-8
    close(array(got, "u", spec.n), u, 1e-7)
    close(array(solvers.direct(g, spec, op, "u", "b"), "u", spec.n), u)
    before = np.abs(op.numpy(u)).max()
    g = solvers.v_cycle(g, spec, "u", "b", 1, 1, 40)
    assert np.abs(op.numpy(u - array(g, "u", spec.n))).max() < 0.5 * before
    g = solvers.red_black(grid(spark, u=0 * u, b=op.numpy(u)), spec, op, "u", "b", 2, 1.3)
    x = 0 * u
    even = np.indices(spec.n).sum(0) % 2 == 0
    for _ in range(2):
        for mine in (even, ~even):
            new = (op.numpy(u) - op.numpy(x) - 6 * x) / -6
            x = np.where(mine, x + 1.3 * (new - x), x)
    close(array(g, "u", spec.n), x)


def test_integrators(spark):
    a = field(10, (4, 1, 1))
    rhs = lambda g, t: g.withColumn("d_f", -F.col("f") + F.lit(t))
    exact = lambda t: (a + 1) * np.exp(-t) + t - 1
    for order in (1, 2, 3):
        errors = [np.abs(array(integrate.step(grid(spark, f=a), ("f",), rhs, 0.0, h, order), "f", a.shape) - exact(h)).max() for h in (0.2, 0.1)]
        assert errors[0] / errors[1] > 2 ** (order + 1) * 0.75
    errors, estimates = [], []
    for h in (0.4, 0.2):
        got, error = integrate.rkf4(grid(spark, f=a), ("f",), rhs, 0.0, h)
        errors.append(np.abs(array(got, "f", a.shape) - exact(h)).max())
        estimates.append(error)
    assert errors[0] / errors[1] > 2**5 * 0.75 and 2**4 * 0.75 < estimates[0] / estimates[1] < 2**4 * 1.4
    seen = []
    integrate.run(grid(spark, f=a), ("f",), rhs, 2, 0.1, every={2: lambda k, t, g: seen.append((k, round(t, 6)))})
    assert seen == [(2, 0.2)]


def test_fluid_at_rest_stays_and_waves_are_solenoidal(spark):
    spec = GridSpec((8, 8, 8), length=(2 * np.pi,) * 3)
    fluid = integrate.Fluid()
    rest = spec.keys(spark).select(*AXES, *(F.lit(0.0).alias(f) for f in fluid.fields))
    r = fluid.rhs(spec)(rest, 0.0).agg(*(F.max(F.abs(F.col(f"d_{f}"))).alias(f) for f in fluid.fields)).first()
    assert max(r) == 0
    h = integrate.Helical((1.0, 2.0, 0.0), helicity=0.5)
    g = spec.keys(spark).select(*AXES, *(c.alias(k) for k, c in zip("abc", h.columns(spec))))
    k = np.array([array(g, n, spec.n) for n in "abc"])
    assert np.abs(k[0] + 2 * k[1]).max() < 1e-12


def test_harmonics(spark):
    spec = GridSpec((9, 9, 9))
    a = np.zeros(spec.n)
    a[4, 4, 4] = 1.0
    m = harmonics.moments(grid(spark, f=a), spec, "f", 2)
    assert m.first()["q_0_0"] == pytest.approx(1 / np.sqrt(4 * np.pi))
    far = array(harmonics.potential(grid(spark, f=a), spec, m, 2, "u"), "u", spec.n)
    assert far[8, 4, 4] == pytest.approx(1 / (4 * np.pi * 4))


def test_scalar_functions(spark):
    d = spark.createDataFrame([(-7.5,), (7.5,), (0.0,), (-0.5,), (2.0,)], "a double")
    got = d.select("a", scalar.mod(F.col("a"), 2.0).alias("m"), scalar.modulo(F.col("a"), 2.0).alias("n"), scalar.nint(F.col("a")).alias("i"), scalar.log(F.col("a")).alias("l"), scalar.quintic_step(F.col("a"), 0.0, 2.0).alias("q")).collect()
    for r in got:
        assert r.m == pytest.approx(np.fmod(r.a, 2)) and r.n == pytest.approx(np.mod(r.a, 2))
        assert r.i == (np.floor(abs(r.a) + 0.5) * np.sign(r.a))
        assert r.l == pytest.approx(np.log(r.a)) if r.a > 0 else (np.isneginf(r.l) if r.a == 0 else np.isnan(r.l))
        assert 0 <= r.q <= 1
    z = algebra.Complex(F.lit(1.0), F.lit(2.0)) / algebra.Complex(F.lit(3.0), F.lit(-1.0))
    m = [[F.lit(float(3 * i + j * j)) for j in range(3)] for i in range(3)]
    r = spark.range(1).select(z.re.alias("re"), z.im.alias("im"), algebra.determinant(m).alias("d"), algebra.matvec(m, m[1])[2].alias("v"), algebra.add(m, 1.0)[2][2].alias("e")).first()
    n = np.array([[3 * i + j * j for j in range(3)] for i in range(3)])
    assert complex(r.re, r.im) == pytest.approx((1 + 2j) / (3 - 1j)) and r.d == pytest.approx(np.linalg.det(n)) and r.v == (n @ n[1])[2] and r.e == 11


def test_mesh_files(spark, tmp_path):
    a, b = field(11), field(12)
    g = grid(spark, f=a)
    mesh.write_snapshot(g, f"file://{tmp_path}/snap", 4)
    close(array(mesh.read_snapshot(spark, f"file://{tmp_path}/snap", (2, 5), 4), "f")[:, :, 2:5], a[:, :, 2:5])
    assert mesh.write_raw(g, SPEC, f"file://{tmp_path}/raw", "f", layers=3).count() == 3
    close(array(mesh.read_raw(spark, f"file://{tmp_path}/raw", SPEC, "f"), "f"), a)
    padded = np.array([np.pad(v, 3).transpose(2, 1, 0) for v in (a, b)])
    (tmp_path / "var.dat").write_bytes(padded.astype("<f8").tobytes())
    got = mesh.read_interleaved(spark, f"file://{tmp_path}/var.dat", SPEC, ("f", "g"))
    close(array(got, "g"), b)
    conf = {"nx": 3, "dt": 0.5, "name": "run", "on": True, "list": [1, 2]}
    assert mesh.parse_config(mesh.write_config(conf) + "// note\n") == conf


def test_steps(spark):
    @kernel(reach=1)
    def smooth_line(g, spec):
        return S.apply(g, spec, {"f": (S.binomial(1, (0,)), "f")})

    spec = GridSpec((6, 1, 1), periodic=(False, False, False))
    a = field(13, spec.n)
    steps = Steps(spec, {"f": boundary.Condition("symmetric")}).call("smooth_line").reduce(top=F.max("f")).call(Kernel(lambda g, s, m: g.withColumn("f", F.col("f") / F.lit(m))), m="top")
    p = np.pad(a[:, 0, 0], 1, mode="reflect")
    want = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    close(array(steps.run(grid(spark, f=a)), "f", spec.n)[:, 0, 0], want / want.max())
    assert "smooth_line" in KERNELS
    close(array(windowed(grid(spark, f=a), {"f": F.lit(1.0)}, F.col("x") > 2), "f", spec.n)[3:], 1)


def test_stream_bins(spark, tmp_path):
    import datetime as dt

    from trellis.streaming import bins

    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=7 * k), float(k)) for k in range(30)]
    spark.createDataFrame(rows, "ts timestamp, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{tmp_path}/in")
    got = []
    q = bins.each_batch(bins.binned(stream, "1 hour", "0 seconds"), lambda d, k: got.extend(d.collect()), f"{tmp_path}/cp", "update")
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in got) == 30
    out = bins.smoothed(spark.createDataFrame(got), 3600, S.binomial(1, (0,))).orderBy("bin").collect()
    assert out[0].smooth == pytest.approx((2 * out[0].v + out[1].v) / 4)


def test_walk_and_random(spark):
    spec = GridSpec((8, 8, 8))
    w = spark.range(200).select("id", *(F.lit(4.0).alias(f"p{a}") for a in AXES))
    a, b = (integrate.walk(x, spec, 3, 5).orderBy("id").collect() for x in (w, w.repartition(7)))
    assert a == b and all(0 <= v < 8 for r in a for v in r[1:])
    r = spec.keys(spark).select(integrate.normal_random(3).alias("v")).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(r[0]) < 0.2 and abs(r[1] - 1) < 0.15


@pytest.mark.parametrize("dims", [2, 3])
def test_moving_grid(spark, dims):
    from trellis.operators import moving

    spec = GridSpec((6, 5, 4) if dims == 3 else (6, 5, 1), periodic=(False, False, False))
    k = np.indices(spec.n).astype(float)
    p = k + 0.2 * np.random.default_rng(1).uniform(-1, 1, k.shape)
    f = 2 * p[0] - 3 * p[1] + 0.5 * p[2] * (dims == 3)
    g = grid(spark, px=p[0], py=p[1], pz=p[2], f=f)
    got = moving.average_gradient(g, spec, {a: f"p{AXES[a]}" for a in range(dims)}, "f")
    inner = (slice(1, -1),) * 2 + ((slice(1, -1),) if dims == 3 else (slice(None),))
    for a, want in zip("xyz"[:dims], (2, -3, 0.5)):
        close(array(got, f"grad_{a}", spec.n)[inner], want)
    per = GridSpec(spec.n)
    near = array(moving.coordinate_ghosts(g, per, {0: "px"}, ("f",), 0, 1), "px", (8, *spec.n[1:]), (-1, 0, 0))
    close(near[0], p[0][-1] - 6)
    close(near[7], p[0][0] + 6)
