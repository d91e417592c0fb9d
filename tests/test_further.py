"""Many images in one raster, odd values, three dimensions, and operators without SQL, by brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake import graph
from voxelake.operators import diffusion, geometry, growing, labels, lines, morphology, reduce, resample, window
from voxelake.raster import Geometry, from_table
from voxelake.sources import images

rng = np.random.default_rng(4)


def raster(spark, *arrays, pixel="float64"):
    """Arrays (z, y, x) of one shape as the images of a raster."""
    shape = arrays[0].shape
    axes = "xyz"[: len(shape)]
    rows = [(k, *map(int, at[::-1]), a[at].item()) for k, a in enumerate(arrays) for at in np.ndindex(*shape)]
    df = spark.createDataFrame(rows, f"image_id long, {', '.join(f'{x} int' for x in axes)}, v {'double' if pixel.startswith('float') else 'long'}")
    return from_table(df, Geometry(shape[::-1]), pixel)


def array(r, image=0):
    out = np.full(r.geometry.size[::-1], np.nan)
    for row in r.df.where(F.col("image_id") == image).collect():
        out[tuple(row[a] for a in reversed(r.axes))] = row.v
    return out


@pytest.mark.parametrize("fn", [
    lambda r: diffusion.gradient_anisotropic_diffusion(r, iterations=2), lambda r: diffusion.curvature_anisotropic_diffusion(r, iterations=1),
    lambda r: diffusion.adaptive_histogram_equalization(r, (1, 1)), lambda r: diffusion.histogram_matching(r, r.map(lambda v: v * 3 + 1)),
    lambda r: growing.confidence_connected(r, [(2, 2)], 1.0, 1), lambda r: labels.label_voting([r.map(lambda v: F.floor(v / 30)), r.map(lambda v: F.floor(v / 40))]),
    lambda r: reduce.rescale_intensity(r, 0, 1), lambda r: labels.connected_component(r.map(lambda v: F.when(v > 50, 1).otherwise(0))), morphology.grayscale_fillhole,
    lambda r: reduce.scalar_image_kmeans(r, [10, 60, 500])[0],
])
def test_an_image_does_not_change_its_neighbours(spark, fn):
    a, b = rng.integers(0, 100, (5, 6)).astype(float), rng.integers(0, 1000, (5, 6)).astype(float)
    both = fn(raster(spark, a, b))
    np.testing.assert_allclose(array(both, 0), array(fn(raster(spark, a))))
    np.testing.assert_allclose(array(both, 1), array(fn(raster(spark, b))))


def test_reconstruction_ends_on_nan_and_infinity(spark):
    a = rng.integers(0, 9, (4, 6)).astype(float)
    a[1, 2], a[2, 4], a[0, 0] = np.nan, np.inf, -np.inf
    out = array(morphology.h_maxima(raster(spark, a), 2))
    assert out.shape == a.shape and not np.isnan(out[3]).any()


@pytest.mark.parametrize("fully", [False, True])
def test_reconstruction_across_tiles(spark, monkeypatch, fully):
    monkeypatch.setattr(labels, "TILE_VOXELS", 27)
    mask = rng.integers(0, 20, (5, 7, 8)).astype(float)
    marker = np.where(rng.random(mask.shape) < 0.05, mask, 0.0)
    want, steps = np.minimum(marker, mask), [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1 or (fully and any(o))]
    while True:
        p = np.pad(want, 1, constant_values=-np.inf)
        new = np.minimum(mask, np.max([want, *(p[tuple(slice(1 + k, n - 1 + k) for k, n in zip(o, p.shape))] for o in steps)], axis=0))
        if (new == want).all():
            break
        want = new
    np.testing.assert_array_equal(array(morphology.reconstruction(raster(spark, marker), raster(spark, mask), fully_connected=fully)), want)
    np.testing.assert_array_equal(array(morphology.reconstruction(raster(spark, -marker), raster(spark, -mask), "erosion", fully)), -want)


@pytest.mark.parametrize("voxels", [27, 1 << 17])
def test_blocks_of_a_volume(spark, monkeypatch, voxels):
    monkeypatch.setattr(window, "BLOCK_VOXELS", voxels)
    a = rng.integers(0, 50, (5, 7, 8)).astype(float)
    r, k = raster(spark, a, a + 1), (2, 1, 1)
    boxes = lambda p: np.lib.stride_tricks.sliding_window_view(p, [3, 3, 5]).reshape(*a.shape, -1)
    edge, blank = np.pad(a, [(1, 1), (1, 1), (2, 2)], mode="edge"), np.pad(a, [(1, 1), (1, 1), (2, 2)], constant_values=np.nan)
    np.testing.assert_allclose(array(window.mean(r, k)), boxes(edge).mean(-1))
    np.testing.assert_array_equal(array(window.median(r, k)), np.median(boxes(edge), -1))
    np.testing.assert_array_equal(array(window.median(r, k), 1), np.median(boxes(edge), -1) + 1)
    np.testing.assert_array_equal(array(window.rank(r, k, 0)), np.nanmin(boxes(blank), -1))
    np.testing.assert_array_equal(array(morphology.grayscale_dilate(r, k)), np.nanmax(boxes(blank), -1))
    g = np.gradient(np.pad(a, 1, mode="edge"))
    np.testing.assert_allclose(array(window.gradient_magnitude(r)), np.sqrt(sum(x[1:-1, 1:-1, 1:-1] ** 2 for x in g)), rtol=1e-6)


def brute_curvature(a, step):
    p = np.pad(a, 1, mode="edge")
    at = lambda *o: p[tuple(slice(1 + k, n - 1 + k) for k, n in zip(o, p.shape))]
    unit = lambda i, s=1: tuple(s if j == i else 0 for j in range(a.ndim))
    d = [(at(*unit(i)) - at(*unit(i, -1))) / 2 for i in range(a.ndim)]
    square = sum(x * x for x in d)
    bend = np.zeros_like(a)
    for i, j in itertools.permutations(range(a.ndim), 2):
        both = lambda s, t: tuple(s if k == i else t if k == j else 0 for k in range(a.ndim))  # noqa: B023, E731
        mixed = (at(*both(1, 1)) - at(*both(1, -1)) - at(*both(-1, 1)) + at(*both(-1, -1))) / 4
        bend += (at(*unit(i)) - 2 * a + at(*unit(i, -1))) * d[j] ** 2 - d[i] * d[j] * mixed
    return a + step * np.where(square < 1e-12, 0, bend / np.where(square < 1e-12, 1, square))


def test_curvature_flow_in_three_dimensions(spark):
    a = rng.random((4, 5, 6)) * 9
    np.testing.assert_allclose(array(window.curvature_flow(raster(spark, a), 0.05, 1)), brute_curvature(a, 0.05))


@pytest.mark.parametrize("fn", [diffusion.canny_edge_detection, diffusion.objectness_measure, morphology.binary_thinning])
def test_plane_operators_refuse_volumes(spark, fn):
    with pytest.raises(ValueError, match="two dimensions"):
        fn(raster(spark, np.ones((2, 2, 2))))


@pytest.mark.parametrize("pixel, value", [("int64", 2**53 + 1), ("int64", -(2**63)), ("uint64", 2**64 - 1)])
def test_files_keep_64_bit_digits(spark, pixel, value):
    df = spark.createDataFrame([(0, 0, 0, value if pixel == "int64" else str(value)), (0, 1, 0, 3 if pixel == "int64" else "3")], f"image_id long, x int, y int, v {'long' if pixel == 'int64' else 'string'}")
    r = from_table(df.withColumn("v", F.col("v").cast("decimal(20,0)")), Geometry((2, 1)), pixel)
    back = images.decode(images.encode(r, "nrrd"), "nrrd")
    assert {int(x.v) for x in back.df.collect()} == {value, 3}


def test_metaimage_bytes_by_the_format(spark):
    """A file written out here byte by byte: three rows of two 16-bit numbers, most significant byte first."""
    head = b"ObjectType = Image\nNDims = 2\nBinaryData = True\nBinaryDataByteOrderMSB = True\nDimSize = 2 3\nElementSpacing = 0.5 2\nOffset = 1 -1\nElementType = MET_SHORT\nElementDataFile = LOCAL\n"
    body = bytes([0, 1, 0, 2, 1, 0, 255, 255, 128, 0, 127, 255])
    r = images.decode(spark.createDataFrame([(0, bytearray(head + body))], "image_id long, content binary"), "mha")
    np.testing.assert_array_equal(array(r), [[1, 2], [256, -1], [-32768, 32767]])
    assert r.geometry.spacing == (0.5, 2.0) and r.geometry.origin == (1.0, -1.0)


def test_envelope_by_all_pairs():
    for n in (1, 2, 7, 40):
        f = rng.integers(0, 30, (25, n)).astype(float)
        f[rng.random(f.shape) < 0.6] = np.inf
        at = np.arange(n) * 0.7
        want = (f[:, None, :] + (at[:, None] - at[None, :]) ** 2).min(2)
        np.testing.assert_allclose(lines._envelope(f, 0.7), want)


def test_roots_of_random_links():
    for _ in range(30):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 50))))
        low = np.arange(n)
        for _ in range(n):
            np.minimum.at(low, a, low[b])
            np.minimum.at(low, b, low[a])
        assert (graph.roots(n, a, b) == low).all()


@pytest.mark.parametrize("fully", [False, True])
def test_components_across_tiles(spark, monkeypatch, fully):
    monkeypatch.setattr(labels, "TILE_VOXELS", 27)
    a = (rng.random((7, 8, 9)) < 0.45).astype(int)
    got = array(labels.connected_component(raster(spark, a, pixel="uint8"), fully)).astype(int)
    want, steps = np.zeros_like(a), [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1 or (fully and any(o))]
    for start in np.ndindex(*a.shape):
        if a[start] and not want[start]:
            todo, want[start] = [start], want.max() + 1
            while todo:
                at = todo.pop()
                for o in steps:
                    n = tuple(i + k for i, k in zip(at, o))
                    if all(0 <= i < m for i, m in zip(n, a.shape)) and a[n] and not want[n]:
                        want[n] = want[start]
                        todo.append(n)
    assert (got == want).all()


def test_threshold_of_most_components(spark):
    a = rng.integers(0, 60, (9, 10))
    mask, threshold, n = labels.threshold_maximum_connected_components(raster(spark, a, pixel="int32"))
    assert (array(mask) == (a >= threshold)).all()
    assert n == array(labels.connected_component(mask)).max()


def test_strict_merge_refuses_a_shared_label(spark):
    runs = spark.createDataFrame([(0, 1, 0, 0, 2)], "image_id long, label long, y int, x int, len long")
    with pytest.raises(Exception, match="two maps hold label 1"):
        labels.merge_label_maps([runs, runs], "strict").collect()
    with pytest.raises(ValueError):
        labels.merge_label_maps([runs, runs], "other")


def test_orientation_codes(spark):
    assert geometry.orientation_of(np.eye(3)) == "LPS" and geometry.orientation_of(-np.eye(3)) == "RAI"
    for code in ("LPS", "RAI", "SRP", "ILA", "PIR"):
        assert geometry.orientation_of(geometry.direction_of(code)) == code
    with pytest.raises(ValueError):
        geometry.direction_of("LLS")
    r = raster(spark, np.arange(24.0).reshape(2, 3, 4))
    out, order, turned = geometry.dicom_orient(r, "AIR")
    assert order == (1, 2, 0) and turned == ("x", "y", "z") and geometry.orientation_of(out.geometry.direction) == "AIR"
    point = {row.v: out.geometry.to_point((row.x, row.y, row.z)) for row in out.df.collect()}
    for row in r.df.collect():
        assert point[row.v] == pytest.approx(r.geometry.to_point((row.x, row.y, row.z)))


def test_transforms_compose_and_invert():
    p = (1.0, -2.0, 0.5)
    spin = resample.similarity_3d(2.0, (0.1, 0.2, 0.3), (1, 2, 3), (4, 5, 6))
    grow = resample.scale_versor_3d((1.5, 2.0, 0.5), (0.1, 0.0, -0.2), (0, 1, 0))
    assert resample.composite([spin, grow]).point(p) == pytest.approx(spin.point(grow.point(p)))
    assert spin.inverse().point(spin.point(p)) == pytest.approx(p)
    assert np.linalg.norm(np.array(spin.point(p)) - spin.point((0, 0, 0))) == pytest.approx(2 * np.linalg.norm(p))
    assert resample.scale_logarithmic((0.0, 1.0)).point((3.0, 2.0)) == pytest.approx((3.0, 2 * math.e))
    assert resample.similarity_2d(3.0, math.pi / 2).point((1.0, 0.0)) == pytest.approx((0.0, 3.0))


def test_wiener_by_the_formula(spark):
    a, k = rng.random((6, 8)) * 9, np.zeros((6, 8))
    k[0, 0], k[0, 1], k[1, 0] = 0.6, 0.3, 0.1
    g, h, noise = np.fft.fft2(a), np.fft.fft2(k), 0.05 * a.size
    signal = np.abs(g) ** 2 - noise
    want = np.fft.ifft2(np.where(signal > 0, g * np.conj(h) / (np.abs(h) ** 2 + noise / np.where(signal > 0, signal, 1)), 0)).real
    np.testing.assert_allclose(array(diffusion.wiener_deconvolution(raster(spark, a), raster(spark, k), 0.05)), want, atol=1e-9)


def test_smooth_sizes_and_time_step():
    assert [lines.smooth_size(n) for n in (1, 7, 11, 64, 97)] == [1, 8, 12, 64, 100] and lines.smooth_size(7, 7) == 7
    assert diffusion.stable_time_step_bound(Geometry((4, 4), (0.5, 2.0))) == 0.0625
