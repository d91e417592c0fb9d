"""Work at size: rows made, tiles, long lines, large grids, and a rule at its limit."""

import itertools
import math
import struct
import tracemalloc

import numpy as np
import pytest

from voxelake import staging
from voxelake.operators import growing, reduce, resample
from voxelake.raster import Geometry, from_table
from voxelake.sources import images

WINDOWS = {
    "lanczos": lambda t: np.sinc(t),
    "cosine": lambda t: math.cos(math.pi * t / 2),
    "hamming": lambda t: 0.54 + 0.46 * math.cos(math.pi * t),
    "blackman": lambda t: 0.42 + 0.5 * math.cos(math.pi * t) + 0.08 * math.cos(2 * math.pi * t),
    "welch": lambda t: 1 - t * t,
}


def raster(spark, a, pixel="float64"):
    """A raster of an array (its axes are x, y, z); masked voxels are left out."""
    rows = [(0, *map(int, i), float(a[i])) for i in np.ndindex(a.shape) if not np.ma.is_masked(a[i])]
    axes = ["x", "y", "z"][: a.ndim]
    return from_table(spark.createDataFrame(rows, "image_id int, " + ", ".join(f"{x} int" for x in axes) + ", v double"), Geometry(a.shape), pixel)


def values(r):
    out = np.full(r.geometry.size, np.nan)
    for row in r.df.collect():
        out[tuple(row[x] for x in r.axes)] = row.v
    return out


def rows_made(df):
    """The most rows that any operator of the plan that ran has made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(plan.finalPhysicalPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = plan.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


def weights(kernel, d):
    if kernel == "gaussian":
        return math.exp(-d * d / (2 * 0.8**2))
    return 0.0 if abs(d) >= 5 else float(np.sinc(d) * WINDOWS[kernel](d / 5))


def interpolated(a, c, kernel):
    """One point by a plain loop over the voxels around it."""
    radius = 3 if kernel == "gaussian" else 5
    if any(not -0.5 <= x < n - 0.5 for x, n in zip(c, a.shape)):
        return -1.0
    total = share = 0.0
    for step in itertools.product(range(1 - radius, radius + 1), repeat=a.ndim):
        w = math.prod(weights(kernel, x - math.floor(x) - k) for x, k in zip(c, step))
        i = tuple(min(max(math.floor(x) + k, 0), n - 1) for x, k, n in zip(c, step, a.shape))
        if w and not np.ma.is_masked(a[i]):
            total, share = total + w * a[i], share + w
    return total / share if kernel == "gaussian" else total


@pytest.mark.parametrize("kernel", ["lanczos", "welch", "blackman", "gaussian", "hamming", "cosine"])
def test_windowed_resampling_over_tiles(spark, monkeypatch, kernel):
    """Small tiles, crowded tiles and missing voxels give what a loop gives, and no row for each pair of voxels."""
    monkeypatch.setattr("voxelake.operators.window.BLOCK_VOXELS", 100)
    monkeypatch.setattr(resample, "TILE_POINTS", 40, raising=False)
    a = np.ma.masked_array(np.random.default_rng(1).normal(100, 20, (17, 23)), mask=np.zeros((17, 23), bool))
    a.mask[3, 4] = a.mask[16, 0] = True
    out = resample.resample(raster(spark, a), Geometry((30, 20)), resample.Affine(((0.5, 0.1), (-0.2, 1.2)), (0.3, 1.7)), kernel, -1)
    expected = np.array([[interpolated(a, (0.5 * x + 0.1 * y + 0.3, -0.2 * x + 1.2 * y + 1.7), kernel) for y in range(20)] for x in range(30)])
    assert np.allclose(values(out), expected, atol=1e-9)
    assert rows_made(out.df) <= 15 * 17 * 23


def arrival(f, h, seed, stop):
    """Sweeps over all voxels until no arrival time falls."""
    t = np.full(f.shape, np.inf)
    t[seed] = 0.0
    while True:
        before = t.copy()
        for i in np.ndindex(f.shape):
            if not f[i] > 0:
                continue
            near = []
            for k in range(f.ndim):
                beside = [t[tuple(x + (o if j == k else 0) for j, x in enumerate(i))] for o in (-1, 1) if 0 <= i[k] + o < f.shape[k]]
                near.append((min(beside, default=np.inf), 1 / h[k] ** 2))
            for n in range(1, f.ndim + 1):
                for used in itertools.combinations(near, n):
                    if any(np.isinf(x) for x, _ in used):
                        continue
                    a, b = sum(w for _, w in used), sum(x * w for x, w in used)
                    disc = b * b - a * (sum(x * x * w for x, w in used) - 1 / f[i] ** 2)
                    root = (b + math.sqrt(max(disc, 0.0))) / a
                    if disc >= 0 and root <= stop and all(root >= x for x, _ in used):
                        t[i] = min(t[i], root)
        if np.array_equal(before, t):
            return t


@pytest.mark.parametrize("shape", [(9, 14), (5, 4, 6)])
def test_fast_marching_over_tiles(spark, monkeypatch, shape):
    """Tiles of a few voxels, a wall with a gap, speeds of zero and NaN, spacing and a stop."""
    monkeypatch.setattr(growing, "TILE_VOXELS", 18, raising=False)
    f = np.random.default_rng(2).uniform(0.2, 2, shape)
    f[2, 1:] = 0.0
    f[-1, 2] = np.nan
    f[(-1, *[0] * (len(shape) - 1))] = -1.0
    h = (0.7, 1.0, 1.6)[: len(shape)]
    speed = raster(spark, f)
    speed = speed.with_rows(speed.df, Geometry(shape, h))
    seed = (4, *[3] * (len(shape) - 1))
    for stop in (np.inf, 3.0):
        t = values(growing.fast_marching(speed, [seed], stop))
        assert np.allclose(t, arrival(f, h, seed, stop), rtol=1e-9)


def test_fast_marching_passes_a_long_tile_in_one_round(spark, monkeypatch):
    rounds = []

    def counted(df):
        rounds.append(1)
        assert len(rounds) <= 3, "a round for every few voxels"
        return staging.staged(df)

    monkeypatch.setattr(growing, "staged", counted)
    t = values(growing.fast_marching(raster(spark, np.full((2, 300), 2.0)), [(0, 0)]))
    assert np.allclose(t[0], np.arange(300) / 2) and t[1, 0] == 0.5


def test_bspline_coefficients_take_memory_of_the_line(spark):
    """A line's equations are not a square matrix; the spline passes through the voxels."""
    from voxelake.operators import lines

    kernels, along = [], lines.along
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lines, "along", lambda r, a, kernel: kernels.append(kernel) or along(r, a, kernel))
        coefficients = values(resample.bspline_coefficients(raster(spark, np.arange(35.0).reshape(5, 7) ** 2)))
    padded = np.pad(coefficients, 1, mode="edge")
    through = padded[:-2] + 4 * padded[1:-1] + padded[2:]
    assert np.allclose((through[:, :-2] + 4 * through[:, 1:-1] + through[:, 2:]) / 36, np.arange(35.0).reshape(5, 7) ** 2)
    for n in (1, 2, 3, 4):
        line = np.arange(1.0, n + 1)[None] ** 2
        c = np.pad(kernels[0](line)[0], 1, mode="edge")
        assert np.allclose((c[:-2] + 4 * c[1:-1] + c[2:]) / 6, line[0])
    tracemalloc.start()
    kernels[0](np.ones((2, 3000)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2_000_000


@pytest.mark.parametrize("size", [(2, 40_000), (32_767, 1), (32_768, 1, 2)])
def test_nifti_of_long_sides(size):
    """Sides of over 16 bits are written as NIfTI-2, others as NIfTI-1; both are read again."""
    a = np.random.default_rng(5).integers(-(2**31), 2**31, size[::-1]).astype(np.int32)
    three = {"origin": (1.5, -2.25, 3.1), "direction": ((0, 1, 0), (1, 0, 0), (0, 0, 1))} if len(size) == 3 else {}
    g = Geometry(size, (0.1, 2.0, 0.3)[: len(size)], **three)
    data = images.encode_nifti(a, g, "int32")
    b, back, pixel = images.decode_nifti(data)
    assert np.array_equal(a, b) and pixel == "int32" and back.congruent(g)
    if max(size) > 32_767:
        assert data[:12] == struct.pack("<i", 540) + b"n+2\0\r\n\x1a\n" and struct.unpack_from("<8q", data, 16)[: len(size) + 1] == (len(size), *size)
        assert struct.unpack_from("<q", data, 168) == (544,) and len(data) == 544 + a.nbytes
    else:
        assert data[:4] == struct.pack("<i", 348) and data[344:348] == b"n+1\0" and len(data) == 352 + a.nbytes


def test_nifti_2_of_the_other_byte_order():
    """A header of 540 bytes by the places that the format gives, big-endian."""
    h = bytearray(544)
    struct.pack_into(">i8shh8q", h, 0, 540, b"n+2\0\r\n\x1a\n", 512, 16, 3, 3, 2, 2, 1, 1, 1, 1)
    struct.pack_into(">8dq", h, 104, 1, 0.5, 2, 4, 0, 0, 0, 0, 544)
    struct.pack_into(">i", h, 348, 1)
    struct.pack_into(">12d", h, 400, -0.5, 0, 0, -7, 0, -2, 0, -8, 0, 0, 4, 9)
    a, g, pixel = images.decode_nifti(bytes(h) + np.arange(12, dtype=">u2").tobytes())
    assert a.shape == (2, 2, 3) and a.ravel().tolist() == list(range(12)) and pixel == "uint16"
    assert g.congruent(Geometry((3, 2, 2), (0.5, 2, 4), (7, 8, 9)))


def test_intermodes_takes_what_a_thousand_smoothings_leave():
    """The second lump meets the first just at the last smoothing, or one later; one bin is its own middle."""

    def three(middle):
        counts = [0] * 400
        counts[60], counts[134], counts[330] = 1000, middle, 1000
        return list(range(400)), list(range(1, 401)), counts

    assert 60 < reduce.RULES["intermodes"](three(319)) < 330
    with pytest.raises(ValueError, match="bimodal"):
        reduce.RULES["intermodes"](three(320))
    assert reduce.RULES["intermodes"](([4.0], [6.0], [7])) == 5.0
