"""N4 bias correction: its parts by brute force, a planted field, masks, weights and many images."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.operators import bias
from voxelake.raster import Geometry, from_table

SIZE = (26, 24)
rng = np.random.default_rng(3)


def planted(x, y):
    u, v = x / SIZE[0], y / SIZE[1]
    return 0.3 * u - 0.2 * v + 0.25 * u * v - 0.1 * (u - 0.4) ** 2


def tissue(x, y):
    return (150.0 if (x - 12) ** 2 + (y - 11) ** 2 < 60 else 80.0) * (1 + 0.01 * ((3 * x + 5 * y) % 4))


def raster(spark, *functions, size=SIZE):
    axes = "xyz"[: len(size)]
    rows = [(k, *p, float(f(*p))) for k, f in enumerate(functions) for p in itertools.product(*map(range, size))]
    return from_table(spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{a} int" for a in axes) + ", v double").repartition(3), Geometry(size))


def array(r, image=0, size=SIZE):
    out = np.full(size, np.nan)
    for row in r.df.where(F.col("image_id") == image).collect():
        out[tuple(row[a] for a in r.axes)] = row.v
    return out


def one_at_a_time(a, controls, order, levels, threshold, width, noise, bins, weight):
    """N4 with plain loops and dense arrays."""
    dim, cells = a.ndim, list(np.ndindex(*a.shape))
    log = np.where(a > 0, np.log(np.where(a > 0, a, 1)), a)
    spline = lambda u: sum((-1) ** k * math.comb(order + 1, k) * max(u + (order + 1) / 2 - k, 0) ** order for k in range(order + 2)) / math.factorial(order)

    def weights(controls):
        out = {}
        for p in cells:
            each = []
            for k in range(dim):
                spans = controls[k] - order
                u = min(p[k] * spans / (a.shape[k] - 1), spans - spans / (a.shape[k] - 1) * 1e-3)
                each.append([spline(u - i + (order - 1) / 2) for i in range(controls[k])])
            out[p] = np.multiply.outer(*each) if dim == 2 else np.einsum("a,b,c->abc", *each)
        return out

    lattice, field = np.zeros(controls), np.zeros(a.shape)
    t = weights(controls)
    for level, most in enumerate(levels):
        for _ in range(most):
            u = log - field
            held = [p for p in cells if weight[p] > 0]
            low, high = min(u[p] for p in held), max(u[p] for p in held)
            slope = (high - low) / (bins - 1)
            counts = np.zeros(bins + 1)
            for p in held:
                at = (u[p] - low) / slope
                k = int(at)
                if at == k or k < bins - 1:
                    counts[k] += 1 - (at - k)
                    counts[k + 1] += at - k
            e = bias.sharpened(counts[:bins], low, slope, width, noise)
            above, below = np.zeros(controls), np.zeros(controls)
            for p in held:
                at = (u[p] - low) / slope
                k = int(at)
                left = u[p] - (e[k] + (e[k + 1] - e[k]) * (at - k) if k < bins - 1 else e[-1])
                w = t[p]
                above += weight[p] * w**2 * (w * left / (w**2).sum())
                below += weight[p] * w**2
            lattice = lattice + np.where(below > 0, above / np.where(below > 0, below, 1), 0)
            new = np.array([(t[p] * lattice).sum() for p in cells]).reshape(a.shape)
            ratio = np.exp(np.array([field[p] - new[p] for p in held]))
            field = new
            if ratio.std(ddof=1) / ratio.mean() <= threshold:
                break
        if level + 1 < len(levels):
            flat, bigger = bias.refined(lattice.ravel(order="F"), controls, order)
            lattice, controls = flat.reshape(bigger, order="F"), bigger
            t = weights(controls)
    return field


def test_splines_of_any_order():
    t = np.linspace(0, 1, 7, endpoint=False)
    for order in (1, 2, 3, 4):
        w = bias.basis(t, order)
        assert np.allclose(w.sum(1), 1) and (w >= 0).all()
    assert np.allclose(bias.basis(np.array([0.0]), 3), [[1 / 6, 4 / 6, 1 / 6, 0]])


def test_refinement_keeps_the_spline():
    for order, controls in ((3, [5, 4]), (2, [4, 6]), (1, [2, 3])):
        lattice = rng.normal(0, 1, math.prod(controls))
        finer, more = bias.refined(lattice, controls, order)
        index = rng.integers(0, 9, (40, 2)).astype(float)
        value = lambda l, c: (lambda f, w: (w * l[f]).sum(1))(*bias.support(index, (10, 9), c, order))  # noqa: B023, E731
        inner = (index < [9, 8]).all(1)  # the last voxel is moved by a part of the spacing
        assert np.allclose(value(finer, more)[inner], value(lattice, controls)[inner])


def test_sharpening_separates_modes():
    x = np.arange(60)
    blurred = np.exp(-((x - 20) ** 2) / 18) + np.exp(-((x - 40) ** 2) / 18)
    e = bias.sharpened(1000 * blurred, 0.0, 1.0, 2.355 * 3, 0.01)
    assert abs(e[17] - 20) < 2 > abs(e[43] - 40) and np.all(np.diff(e[12:48]) > -0.2)


@pytest.mark.parametrize("size,controls,order,levels", [((9, 8), (4, 4), 3, (2, 2)), ((7, 9), (4, 5), 2, (3,)), ((5, 6, 4), (4, 4, 4), 3, (2,))])
def test_n4_meets_plain_loops(spark, size, controls, order, levels):
    make = lambda seed: (lambda g: lambda *p: g[p])(np.exp(np.random.default_rng(seed).normal(4, 0.3, size)) * (1 + np.indices(size)[0] / 9))
    images, weight = [make(1), make(2)], np.random.default_rng(5).uniform(-0.2, 1, size)
    r, w = raster(spark, *images, size=size), raster(spark, *[lambda *p: weight[p]] * 2, size=size)
    _, field = bias.n4_bias_field(r, confidence=w, levels=levels, controls=controls, order=order, bins=40)
    for i, f in enumerate(images):
        a = np.array([f(*p) for p in np.ndindex(*size)]).reshape(size)
        assert np.allclose(array(field, i, size), one_at_a_time(a, list(controls), order, levels, 0.001, 0.15, 0.01, 40, weight), atol=1e-8)


def test_planted_field_is_found(spark):
    biased = lambda x, y: tissue(x, y) * math.exp(planted(x, y))
    right, field = bias.n4_bias_field(raster(spark, biased), levels=(12, 8), controls=(4, 4))
    want = np.array([planted(*p) for p in np.ndindex(*SIZE)]).reshape(SIZE)
    got, fixed = array(field), array(right)
    assert np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.98
    assert np.abs((got - got.mean()) - (want - want.mean())).max() < 0.08
    before = np.array([biased(*p) for p in np.ndindex(*SIZE)]).reshape(SIZE)
    inside = np.array([tissue(*p) > 120 for p in np.ndindex(*SIZE)]).reshape(SIZE)
    for part in (inside, ~inside):
        assert fixed[part].std() / fixed[part].mean() < 0.5 * before[part].std() / before[part].mean()
    assert np.allclose(fixed, before / np.exp(got))


def test_masks_and_refusals(spark):
    r = raster(spark, lambda x, y: 5.0, size=(6, 5))
    mask = r.map(lambda v: F.when(F.col("x") < 3, 2).otherwise(0), "uint8")
    right, field = bias.n4_bias_field(r, mask, levels=(2,), controls=(4, 4))
    assert right.df.count() == 30 and {row.v for row in field.df.collect()} == {0.0}
    right, field = bias.n4_bias_field(r, mask, levels=(2,), controls=(4, 4), mask_label=None)
    assert np.allclose(array(right, size=(6, 5)) * np.exp(array(field, size=(6, 5))), 5)
    for wrong in ({"bins": 1}, {"order": 0}, {"levels": ()}, {"levels": (0,)}, {"controls": (3, 4)}, {"controls": (4,)}):
        with pytest.raises(ValueError):
            bias.n4_bias_field(r, **wrong)
    with pytest.raises(ValueError):
        bias.n4_bias_field(mask)
