"""Transforms with parameters, metric gradients by finite differences, optimisers and registration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.operators import alignment, parametric
from voxelake.operators.parametric import BSplineTransform, Composite, MatrixTransform
from voxelake.raster import Geometry, from_table

rng = np.random.default_rng(12)
TURNED = ((0.6, -0.8), (0.8, 0.6))


def raster(spark, geometry, *functions):
    """Images whose values are functions of the physical point."""
    axes = "xyz"[: len(geometry.size)]
    rows = [(k, *p, float(f(*geometry.to_point(p)))) for k, f in enumerate(functions) for p in itertools.product(*map(range, geometry.size))]
    return from_table(spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{a} int" for a in axes) + ", v double").repartition(3), geometry)


def blob(cx, cy, w=4.0, h=5.0):
    return lambda x, y: 100 * np.exp(-((x - cx) ** 2) / (2 * w * w) - (y - cy) ** 2 / (2 * h * h)) + 3 * x - y


def random_spline(g, mesh, size=0.4):
    t = BSplineTransform.around(g, mesh)
    return t.with_parameters(rng.normal(0, size, len(t.parameters)))


def test_lattice_geometry():
    t = BSplineTransform.over((0, 0), (8, 8), np.eye(2), (4, 4))
    assert t.lattice.size == (7, 7) and t.lattice.spacing == (2, 2) and t.lattice.origin == (-2, -2)
    t = BSplineTransform.around(Geometry((10, 6), (2.0, 1.0), (3.0, -1.0)), (3, 2))
    assert np.allclose(np.array(t.lattice.origin) + t.lattice.spacing, [3 - 0.625 * 2, -1 - 0.625])
    assert np.allclose(np.array(t.lattice.spacing) * (3, 2), [10.25 * 2, 6.25])
    flipped = BSplineTransform.around(Geometry((10, 6), direction=((0.0, -1.0), (1.0, 0.0))), (3, 2)).lattice
    assert np.allclose(flipped.direction, np.eye(2)) and np.allclose(np.array(flipped.spacing) * (3, 2), [6.25, 10.25])
    with pytest.raises(ValueError):
        BSplineTransform.over((0, 0), (8, 8), np.eye(2), (0, 4))


def test_spline_points_and_inverse():
    g = Geometry((9, 7), (1.0, 1.5), (2.0, 1.0), TURNED)
    t = random_spline(g, (3, 2))
    points = np.array([g.to_point(p) for p in itertools.product(range(9), range(7))])
    lattice = t.lattice
    for p, q in zip(points, t.points(points)):
        index = lattice.to_index(p)
        shift = np.zeros(2)
        for c in itertools.product(*map(range, lattice.size)):
            w = np.prod([parametric.cubic(np.array(i - k)) for i, k in zip(index, c)])
            shift += w * t.controls[:, c[0] + c[1] * lattice.size[0]]
        assert np.allclose(q - p, shift)
    assert np.allclose(t.points(np.array([[1e6, 0.0]])), [[1e6, 0.0]])
    assert np.allclose(t.points(t.inverse_points(t.points(points))), t.points(points)) and np.allclose(t.inverse_points(t.points(points)), points, atol=1e-6)
    same = t.with_parameters(np.repeat([1.5, -0.75], len(t.parameters) // 2))
    assert np.allclose(same.points(points), points + [1.5, -0.75])


def test_displacements_from_a_table(spark):
    g = Geometry((9, 7), (1.0, 1.5), (2.0, 1.0))
    t = BSplineTransform.over((3.0, 2.0), (5.0, 6.0), np.eye(2), (2, 3))
    t = t.with_parameters(rng.normal(0, 1, len(t.parameters)))
    r = raster(spark, g, lambda x, y: 0)
    rows = parametric.displaced(r, t.table(spark)).collect()
    points = np.array([g.to_point((row.x, row.y)) for row in rows])
    assert len(rows) == 63 and np.allclose([row.d for row in rows], t.points(points) - points)


TRANSFORMS = [
    MatrixTransform("translation", 2, (0.3, -0.4)), MatrixTransform("affine", 2, (1.02, 0.03, -0.05, 0.97, 0.4, 0.2), (7.0, 6.0)), MatrixTransform("euler_2d", 2, (0.1, 0.3, -0.2), (7.0, 6.0)),
    MatrixTransform("similarity_2d", 2, (1.05, -0.07, 0.1, 0.2), (3.0, 6.0)), MatrixTransform("scale", 2, (1.03, 0.96), (5.0, 5.0)), MatrixTransform("scale_logarithmic", 2, (0.03, -0.04), (5.0, 5.0)),
    random_spline(Geometry((16, 14)), (3, 4), 0.3), Composite((MatrixTransform("affine", 2, (1.02, 0.03, -0.05, 0.97, 0.1, 0.2)), random_spline(Geometry((16, 14)), (2, 2), 0.3), MatrixTransform("euler_2d", 2, (0.05, 0.3, -0.2)))),
]


@pytest.mark.parametrize("t", TRANSFORMS, ids=lambda t: getattr(t, "kind", type(t).__name__))
def test_moments_and_pulls_meet_differences(t):
    p, g = rng.uniform(2, 11, (30, 2)), rng.normal(0, 1, (30, 2, 2))
    slope, start = t.gradient(t.moments(p, g)), np.array(t.parameters, float)
    for k in rng.choice(len(start), min(8, len(start)), replace=False):
        step = np.zeros(len(start))
        step[k] = 1e-6
        moved = (t.with_parameters(start + step).points(p) - t.with_parameters(start - step).points(p)) / 2e-6
        assert np.allclose(np.einsum("nd,ndk->k", moved, g), slope[k], rtol=1e-5, atol=1e-6)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        moved = (t.points(p + step) - t.points(p - step)) / 2e-6
        assert np.allclose(np.einsum("nd,ndk->nk", moved, g), t.pulled(p, g)[:, k], rtol=1e-5, atol=1e-6)


@pytest.fixture(scope="module")
def pair(spark):
    g = Geometry((14, 12), (1.0, 1.0), (0.5, 0.25))
    m = Geometry((17, 15), (0.9, 1.1), (-0.5, -1.0), ((0.995, -0.0998749218), (0.0998749218, 0.995)))
    return raster(spark, g, blob(7, 6), blob(5, 8)), raster(spark, m, blob(7.6, 5.5), blob(6, 7))


@pytest.mark.parametrize("metric", alignment.METRICS)
@pytest.mark.parametrize("t", [TRANSFORMS[1], TRANSFORMS[2], TRANSFORMS[6], TRANSFORMS[7]], ids=["affine", "euler", "spline", "composite"])
def test_metric_gradients_meet_differences(pair, metric, t):
    points, moving = alignment.samples(pair[0]), alignment.moving_image(pair[1])
    at = lambda p: alignment.evaluate(points, moving, t.with_parameters(p), metric, 20)
    start = np.array(t.parameters, float)
    here = at(start)
    assert sorted(here) == [0, 1]
    for k in rng.choice(len(start), 2, replace=False):
        step = np.zeros(len(start))
        step[k] = 1e-6
        up, down = at(start + step), at(start - step)
        for i in (0, 1):
            if up[i].points == down[i].points:
                assert here[i].gradient[k] == pytest.approx((up[i].value - down[i].value) / 2e-6, rel=2e-3, abs=2e-5 * (1 + abs(here[i].value)))


def test_metric_values(pair):
    """Against plain loops over the points, image by image."""
    t = TRANSFORMS[1]
    points, moving = alignment.samples(pair[0]), alignment.moving_image(pair[1])
    for image in (0, 1):
        table = {(r.x, r.y): r.v for r in pair[1].df.where(F.col("image_id") == image).collect()}
        f, m = [], []
        for r in pair[0].df.where(F.col("image_id") == image).collect():
            c = pair[1].geometry.to_index(t.points(np.array([pair[0].geometry.to_point((r.x, r.y))]))[0])
            if all(-0.5 <= x < n - 0.5 for x, n in zip(c, pair[1].geometry.size)):
                b = np.floor(c).astype(int)
                f.append(r.v)
                m.append(sum(np.prod([(x - i) if k else 1 - (x - i) for x, i, k in zip(c, b, o)]) * table[tuple(min(max(i + k, 0), n - 1) for i, k, n in zip(b, o, pair[1].geometry.size))] for o in itertools.product((0, 1), repeat=2)))
        got = {k: alignment.evaluate(points, moving, t, k)[image] for k in ("mean_squares", "correlation")}
        assert got["mean_squares"].points == len(f) and got["mean_squares"].value == pytest.approx(np.mean((np.array(m) - f) ** 2))
        assert got["correlation"].value == pytest.approx(-np.corrcoef(f, m)[0, 1] ** 2)


def test_cells_and_broadcast_agree(spark, pair):
    half = pair[1].map(lambda v: F.when((F.col("x") + F.col("y")) % 5 > 0, 1).otherwise(0), "uint8")
    for mask in (None, half):
        points = alignment.samples(pair[0])
        whole, cells = alignment.moving_image(pair[1], mask), alignment.moving_image(pair[1], mask, 10)
        assert whole.dense is not None and cells.cells is not None
        for metric in alignment.METRICS:
            a, b = alignment.evaluate(points, whole, TRANSFORMS[6], metric), alignment.evaluate(points, cells, TRANSFORMS[6], metric)
            for i in (0, 1):
                assert a[i].points == b[i].points and a[i].value == pytest.approx(b[i].value) and np.allclose(a[i].gradient, b[i].gradient)
    full = alignment.evaluate(alignment.samples(pair[0]), alignment.moving_image(pair[1]), TRANSFORMS[1])[0].points
    assert alignment.evaluate(alignment.samples(pair[0]), alignment.moving_image(pair[1], half), TRANSFORMS[1])[0].points < full


def test_samples_and_masks(spark, pair):
    fixed = pair[0]
    each = lambda df: sorted((r["image_id"], r["count"]) for r in df.groupBy("image_id").count().collect())
    assert each(alignment.samples(fixed, strategy="regular", percentage=0.3)) == [(0, 42), (1, 42)]
    drawn = alignment.samples(fixed, strategy="random", percentage=0.5, seed=3)
    assert each(drawn) == [(0, 84), (1, 84)] and sorted(map(str, drawn.collect())) == sorted(map(str, alignment.samples(fixed, strategy="random", percentage=0.5, seed=3).collect()))
    mask = fixed.map(lambda v: F.when(F.col("x") < 4, 1).otherwise(0), "uint8")
    assert each(alignment.samples(fixed, mask)) == [(0, 48), (1, 48)]
    with pytest.raises(ValueError):
        alignment.samples(fixed, strategy="some")
    none = alignment.evaluate(alignment.samples(fixed, mask.map(lambda v: v * 0)), alignment.moving_image(pair[1]), TRANSFORMS[0], "mattes")
    assert none == {} == alignment.evaluate(alignment.samples(fixed), alignment.moving_image(pair[1]), MatrixTransform("translation", 2, (1e4, 0)))


def test_volume_gradient(spark):
    g = Geometry((7, 6, 5))
    f = lambda dx: lambda x, y, z: np.sin(0.5 * (x + dx)) + 0.2 * y * z + 0.1 * z * z
    points, moving = alignment.samples(raster(spark, g, f(0))), alignment.moving_image(raster(spark, g, f(0.4)))
    for kind, p in [("euler_3d", (0.05, -0.04, 0.1, 0.2, 0.1, -0.1)), ("versor_rigid_3d", (0.05, -0.04, 0.1, 0.2, 0.1, -0.1)), ("similarity_3d", (0.05, -0.04, 0.1, 0.2, 0.1, -0.1, 1.02)), ("scale_versor_3d", (0.05, -0.04, 0.1, 0.2, 0.1, -0.1, 1.02, 0.97, 1.0))]:
        t = MatrixTransform(kind, 3, p, (3.0, 2.5, 2.0))
        here = alignment.evaluate(points, moving, t)[0]
        for k in range(0, len(p), 3):
            step = 1e-6 * np.eye(len(p))[k]
            up, down = (alignment.evaluate(points, moving, t.with_parameters(np.array(p) + s))[0] for s in (step, -step))
            assert here.gradient[k] == pytest.approx((up.value - down.value) / 2e-6, rel=1e-3, abs=1e-5)


def rosenbrock(x):
    a, b = x[::2], x[1::2]
    g = np.empty(len(x))
    g[::2], g[1::2] = -400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)
    return float((100 * (b - a * a) ** 2 + (1 - a) ** 2).sum()), g


def test_lbfgs_and_its_reasons():
    found = alignment.lbfgs(rosenbrock, [-1.2, 1.0] * 10, accuracy=1e-8)
    assert np.allclose(found.parameters, 1, atol=1e-6) and found.reason == "gradient" and found.iterations < 100
    assert alignment.lbfgs(rosenbrock, [1.0, 1.0]).iterations == 0
    assert alignment.lbfgs(rosenbrock, [-1.2, 1.0], rounds=3).reason == "rounds"
    assert alignment.lbfgs(rosenbrock, [-1.2, 1.0], past=2, delta=0.9).reason == "converged"
    assert alignment.lbfgs(lambda x: (-float(x[0]), np.array([-1.0])), [0.0], evaluations=5).reason == "line_search"
    bowl = lambda x: (float(((x - [3.0, -1.0, 0.5]) ** 2).sum()), 2 * (x - [3.0, -1.0, 0.5]))
    held = alignment.lbfgs(bowl, [0.0, 0.0, 0.0], bounds=([-1, 0, -1], [2, 5, 1]))
    assert np.allclose(held.parameters, [2, 0, 0.5], atol=1e-5) and held.reason == "gradient"
    valley = alignment.lbfgs(rosenbrock, [-1.2, 1.0], bounds=([-2, -2], [0.5, 2]), accuracy=1e-7)
    assert np.allclose(valley.parameters, [0.5, 0.25], atol=1e-4)
    assert alignment.regular_step(bowl, [0.0, 0.0, 0.0], step=1.0, shortest=1e-3).reason in ("step", "gradient")


def test_registration_finds_an_affine(spark):
    g = Geometry((24, 22))
    want = MatrixTransform("affine", 2, (1.03, 0.06, -0.05, 0.96, 0.8, -0.6), (11.5, 10.5))
    f = blob(11, 10)
    fixed, moving = raster(spark, g, lambda x, y: f(*want.points(np.array([[x, y]]))[0])), raster(spark, g, f)
    start = MatrixTransform("affine", 2, centre=want.centre)
    for metric, options in [("mean_squares", {}), ("correlation", {"factors": (2, 1), "sigmas": (1.0, 0.0)})]:
        found, how = alignment.register(fixed, moving, start, metric, scales=alignment.shift_scales(start, g), rounds=25, **options)
        assert np.abs(found.points(np.array([[2.0, 2], [20, 4], [5, 19]])) - want.points(np.array([[2.0, 2], [20, 4], [5, 19]]))).max() < 0.3, metric
        assert how.course[-1] <= how.course[0] and how.reason in ("gradient", "rounds", "line_search", "converged")
    with pytest.raises(ValueError):
        alignment.register(fixed, moving, MatrixTransform("translation", 2, (1e4, 0)))


def test_registration_finds_a_warp(spark):
    g = Geometry((20, 18))
    want = BSplineTransform.around(g, (3, 3))
    want = want.with_parameters(np.random.default_rng(5).uniform(-0.8, 0.8, len(want.parameters)))
    f = lambda x, y: 20 * np.sin(0.3 * x) * np.cos(0.25 * y) + x + 2 * y
    fixed, moving = raster(spark, g, lambda x, y: f(*want.points(np.array([[x, y]]))[0])), raster(spark, g, f)
    found, how = alignment.register(fixed, moving, BSplineTransform.around(g, (3, 3)), rounds=50)
    inner = np.array(list(itertools.product(range(3, 17, 3), range(3, 15, 3))), float)
    assert how.value < 0.1 * how.course[0]
    assert np.abs(found.points(inner) - want.points(inner)).mean() < 0.5 * np.abs(inner - want.points(inner)).mean()
