"""Displacement fields against plain loops, and inverses by composition."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.operators import fields
from voxelake.raster import PIXELS, Geometry, Raster

rng = np.random.default_rng(21)


def field(spark, g, *functions):
    axes = "xyz"[: len(g.size)]
    rows = [(i, *p, [float(x) for x in f(*g.to_point(p))]) for i, f in enumerate(functions) for p in itertools.product(*map(range, g.size))]
    return Raster(spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{a} int" for a in axes) + ", v array<double>").repartition(3), g, PIXELS["float64"])


def array(r, image=0):
    out = np.full((*r.geometry.size, r.dim), np.nan)
    for row in r.df.where(F.col("image_id") == image).collect():
        out[tuple(row[a] for a in r.axes)] = row.v
    return out


def look(g, a, point):
    c = np.array(g.to_index(point))
    if (c < -0.5).any() or (c >= np.array(g.size) - 0.5).any():
        return np.zeros(len(c))
    b, out = np.floor(c).astype(int), np.zeros(len(c))
    for o in itertools.product((0, 1), repeat=len(c)):
        w = np.prod([f if k else 1 - f for k, f in zip(o, c - b)])
        out += w * a[tuple(np.clip(b + o, 0, np.array(g.size) - 1))]
    return out


def inverted(g, a, rounds, largest, mean, hold):
    v = np.zeros_like(a)
    for k in range(rounds):
        rest = np.zeros_like(a)
        for p in np.ndindex(*g.size):
            at = np.array(g.to_point(p)) + v[p]
            rest[p] = v[p] + look(g, a, at)
        norm = np.sqrt(((rest / g.spacing) ** 2).sum(-1))
        part = 0.75 if k == 0 else 0.5
        bound = part * norm.max()
        size = part * np.where(norm > bound, bound / np.where(norm > 0, norm, 1), 1)
        v = v - rest * size[..., None]
        if hold:
            edge = np.zeros(g.size, bool)
            for d, n in enumerate(g.size):
                edge |= np.isin(np.indices(g.size)[d], (0, n - 1))
            v[edge] = 0
        if not (norm.max() > largest and norm.mean() > mean):
            break
    return v, norm.max(), norm.mean()


TURNED = ((0.8, -0.6), (0.6, 0.8))
WAVE = lambda x, y: (0.8 * np.sin(0.5 * x + 0.2 * y), -0.5 * np.cos(0.4 * y))
DRIFT = lambda x, y: (0.3 + 0.05 * x, 0.02 * y)


@pytest.mark.parametrize("g,rounds,hold", [(Geometry((9, 8)), 4, True), (Geometry((8, 7), (1.0, 2.0), (3.0, -1.0), TURNED), 3, False)])
def test_inverse_meets_plain_loops(spark, g, rounds, hold):
    got, norms = fields.invert_displacement_field(field(spark, g, WAVE, DRIFT), rounds, 0.05, 0.001, hold)
    left = {r.image_id: (r.largest, r.mean) for r in norms.collect()}
    for i, f in enumerate((WAVE, DRIFT)):
        a = np.array([f(*g.to_point(p)) for p in np.ndindex(*g.size)]).reshape(*g.size, 2)
        want, largest, mean = inverted(g, a, rounds, 0.05, 0.001, hold)
        assert np.allclose(array(got, i), want) and left[i] == pytest.approx((largest, mean))


def test_composition_with_the_inverse_is_the_identity(spark):
    g = Geometry((12, 11))
    u = field(spark, g, lambda x, y: (0.6 * np.sin(np.pi * x / 11) * np.sin(np.pi * y / 10), 0.4 * np.sin(np.pi * x / 11) * np.sin(np.pi * y / 10)))
    inverse, norms = fields.invert_displacement_field(u, 20, 1e-3, 1e-4)
    both = array(fields.compose(inverse, u))
    assert np.abs(both).max() < 5e-3 and norms.first().largest < 0.02
    again, _ = fields.invert_displacement_field(u, 1, estimate=inverse)
    assert np.allclose(array(again), array(inverse), atol=5e-3)


def test_volume_and_empty(spark):
    g = Geometry((5, 4, 4))
    u = field(spark, g, lambda x, y, z: (0.2 * x, 0.1 * y, -0.1 * z))
    determinant = {round(r.v, 6) for r in fields.jacobian_determinant(u).df.where("x between 1 and 3 and y between 1 and 2 and z between 1 and 2").collect()}
    assert determinant == {round(1.2 * 1.1 * 0.9, 6)}
    a = np.array([(0.2 * x, 0.1 * y, -0.1 * z) for x, y, z in np.ndindex(5, 4, 4)]).reshape(5, 4, 4, 3)
    got, _ = fields.invert_displacement_field(u, 2, hold_border=False)
    assert np.allclose(array(got), inverted(g, a, 2, 0.1, 0.001, False)[0])
    none, norms = fields.invert_displacement_field(Raster(u.df.limit(0), g, u.pixel), 2)
    assert none.df.count() == norms.count() == 0
