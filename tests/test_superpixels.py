"""Super-pixels against a sequential scan in NumPy."""

import itertools
import math

import numpy as np
import pytest

from voxelake.operators import superpixels
from voxelake.raster import Geometry, from_table


def flood(labels, seed, marked):
    """Voxels of one label around a seed that are not marked."""
    found, todo, own = [], [seed], labels[seed]
    marked[seed] = True
    while todo:
        p = todo.pop()
        found.append(p)
        for d, s in itertools.product(range(labels.ndim), (1, -1)):
            q = tuple(x + s * (i == d) for i, x in enumerate(p))
            if all(0 <= x < n for x, n in zip(q, labels.shape)) and not marked[q] and labels[q] == own:
                marked[q] = True
                todo.append(q)
    return found


def scan(shape):
    """All positions, the first axis fastest."""
    return [p[::-1] for p in itertools.product(*(range(n) for n in reversed(shape)))]


def brute_force(a, spacing, grid, weight, rounds, connected, perturb):
    shape, dim = a.shape, a.ndim
    counts = [max(n // g, 1) for n, g in zip(shape, grid)]
    shift = [(n - 1) / 2 - g * (k - 1) / 2 for n, g, k in zip(shape, grid, counts)]
    clip = lambda p: tuple(min(max(x, 0), n - 1) for x, n in zip(p, shape))
    whole = lambda c: tuple(math.floor(x + 0.5) for x in c[1:])
    centres = []
    for j in scan(counts):
        p = clip([x * g + math.floor(s + 0.5) for x, g, s in zip(j, grid, shift)])
        centres.append([a[p], *[x * g + s for x, g, s in zip(j, grid, shift)]])
    if perturb and min(grid) >= 3:
        for c in centres:
            best = (math.inf, None)
            for o in scan([3] * dim):
                p = [m + x - 1 for m, x in zip(whole(c), o)]
                g = 0.0
                for d in range(dim):
                    up, down = [*p], [*p]
                    up[d] += 1
                    down[d] -= 1
                    g += ((a[clip(up)] - a[clip(down)]) / (2 * spacing[d])) ** 2
                if g < best[0]:
                    best = (g, clip(p))
            c[:] = [a[best[1]], *map(float, best[1])]
    labels, residual = np.zeros(shape, int), np.finfo(float).max
    scales = [weight / g for g in grid]
    for _ in range(rounds):
        least = np.full(shape, np.finfo(np.float32).max, np.float32)
        for i, c in enumerate(centres):
            if math.isnan(c[0]):
                continue
            for p in itertools.product(*(range(max(m - g, 0), min(m + g, n - 1) + 1) for m, g, n in zip(whole(c), grid, shape))):
                d = np.float32(c[0] - a[p])
                total = d * d
                for k in range(dim):
                    d = np.float32((c[1 + k] - p[k]) * scales[k])
                    total = total + d * d
                if total < least[p]:
                    least[p], labels[p] = total, i
        old, far = [c[:] for c in centres], 0.0
        for i, c in enumerate(centres):
            at = np.argwhere(labels == i)
            c[:] = [a[labels == i].mean(), *at.mean(0)] if len(at) else [math.nan] * (dim + 1)
            far += sum(np.float32((x - y) * s) ** 2 for x, y, s in zip(c, old[i], [1, *scales]))
        residual = math.sqrt(far) / (len(centres) * (dim + 1))
    if not connected:
        return labels, residual
    least, marked = math.prod(grid) // 4, np.zeros(shape, bool)
    for i, c in enumerate(centres):
        if math.isnan(c[0]):
            continue
        m = whole(c)
        near = [m, *(tuple(x - g // 2 + k for x, g, k in zip(m, grid, o)) for o in scan([2 * (g // 2) + 1 for g in grid]))]
        seed = next((p for p in near if all(0 <= x < n for x, n in zip(p, shape)) and labels[p] == i), None)
        if seed is not None:
            found = flood(labels, seed, marked)
            if len(found) < least:
                marked[tuple(zip(*found))] = False
    following = before = len(centres)
    for p in scan(shape):
        if not marked[p]:
            found = flood(labels, p, marked)
            if len(found) >= least:
                before, following = following, following + 1
            labels[tuple(zip(*found))] = before
        before = labels[p]
    return labels, residual


CASES = [
    ((40, 30), (5, 4), 3.0, 3, True, True, 20, (1.0, 2.0)),
    ((40, 30), (7, 6), 0.3, 2, True, True, 1 << 16, (1.0, 1.0)),
    ((23, 17), (2, 5), 1.0, 4, True, True, 60, (1.0, 1.0)),
    ((9, 8, 7), (3, 4, 3), 2.0, 2, True, True, 30, (1.0, 0.5, 2.0)),
    ((13, 11), (4, 4), 10.0, 2, False, False, 25, (1.0, 1.0)),
    ((2, 9), (5, 3), 1.0, 1, True, True, 1 << 16, (1.0, 1.0)),
]


@pytest.mark.parametrize("shape,grid,weight,rounds,connected,perturb,tile,spacing", CASES)
def test_slic_meets_a_scan(spark, shape, grid, weight, rounds, connected, perturb, tile, spacing):
    rng = np.random.default_rng(len(shape) * 100 + sum(shape))
    images = [np.round(rng.normal(0, 2, shape)) + np.add.outer(*([np.arange(n) // 3 for n in shape[:2]]))[(...,) + (None,) * (len(shape) - 2)], np.zeros(shape)]
    rows = [(i, *map(int, p), float(a[p])) for i, a in enumerate(images) for p in itertools.product(*map(range, shape))]
    axes = "xyz"[: len(shape)]
    df = spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{c} int" for c in axes) + ", v double").repartition(3)
    r = from_table(df, Geometry(shape, spacing))
    labels, residual = superpixels.slic(r, grid, weight, rounds, connected, perturb, tile)
    left = dict(map(tuple, residual.select("image_id", "average_residual").collect()))
    found = labels.df.collect()
    assert len(found) == len(rows)
    for i, a in enumerate(images):
        want, far = brute_force(a, spacing, grid, weight, rounds, connected, perturb)
        got = np.full(shape, -1)
        for row in found:
            if row.image_id == i:
                got[tuple(row[c] for c in axes)] = row.v
        assert (got == want).all()
        assert left[i] == pytest.approx(far, rel=1e-6, nan_ok=True)


def test_slic_without_rounds_or_rows(spark):
    one = from_table(spark.createDataFrame([(3, 0, 0, 1.0)], "image_id long, x int, y int, v double"), Geometry((1, 1)))
    labels, residual = superpixels.slic(one, (50, 50), rounds=0, connected=False)
    assert [tuple(r) for r in labels.df.collect()] == [(3, 0, 0, 0)] and residual.first().average_residual == np.finfo(float).max
    labels, residual = superpixels.slic(from_table(one.df.limit(0), one.geometry), (2, 2))
    assert labels.df.count() == residual.count() == 0
    with pytest.raises(ValueError):
        superpixels.slic(one, (0, 3))
