"""Operators whose results have closed forms or brute-force counterparts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelake.operators import geometry, growing, labels, lines, morphology, noise, optimizers, pixelwise, reduce, registration, resample, window
from voxelake.raster import PIXELS, Geometry, from_table
from voxelake.sources import generators, images

rng = np.random.default_rng(3)


def raster(spark, a, pixel="float64", **where):
    at = np.indices(a.shape)
    axes = "xyz"[: a.ndim]
    rows = [(0, *[int(at[a.ndim - 1 - k].ravel()[i]) for k in range(a.ndim)], float(a.ravel()[i])) for i in range(a.size)]
    df = spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{x} int" for x in axes) + ", v double")
    return from_table(df, Geometry(a.shape[::-1], **where), pixel)


def array(r):
    pdf = r.df.toPandas()
    out = np.full(r.geometry.size[::-1], np.nan)
    out[tuple(pdf[a].to_numpy() for a in reversed(r.axes))] = pdf["v"].astype(float)
    return out


def test_saturation_and_wrap_at_type_edges(spark):
    a = np.array([[np.nan, -1e30, 1e30, -1.9, 255.9, 128.0]])
    assert array(pixelwise.cast(raster(spark, a), "uint8")).tolist() == [[0, 0, 255, 0, 255, 128]]
    assert array(pixelwise.cast(raster(spark, a), "int8")).tolist() == [[0, -128, 127, -1, 127, 127]]
    big = raster(spark, np.array([[200.0, 100.0]]), "uint8")
    assert array(big + big).tolist() == [[144, 200]] and array(big * 2).tolist() == [[144, 200]]
    assert array(-raster(spark, np.array([[-128.0, 5.0]]), "int8")).tolist() == [[-128, -5]]
    assert array(pixelwise.constant(big, "add", 100)).tolist() == [[255, 200]]


def test_division_edges(spark):
    a, b = raster(spark, np.array([[5.0, -5.0, 0.0, 7.0]])), raster(spark, np.array([[0.0, 0.0, 0.0, 2.0]]))
    got = array(pixelwise.binary(a, b, "divide_real"))[0]
    assert got[0] == np.inf and got[1] == -np.inf and np.isnan(got[2]) and got[3] == 3.5
    ints = [raster(spark, np.array([[5.0, -7.0]]), "int32"), raster(spark, np.array([[0.0, 2.0]]), "int32")]
    assert array(pixelwise.divide(*ints)).tolist() == [[2**31 - 1, -3]]


def test_grids_must_agree(spark):
    a = raster(spark, np.ones((2, 2)))
    with pytest.raises(ValueError):
        a + raster(spark, np.ones((2, 2)), origin=(10.0, 0.0))


def test_geometry_follows_the_voxels(spark):
    a = raster(spark, np.arange(24.0).reshape(4, 6), spacing=(2.0, 0.5), origin=(-1.0, 3.0))
    for r in (geometry.flip(a, ("x",)), geometry.region_of_interest(a, (2, 1), (3, 2)), geometry.shrink(a, (2, 2)), geometry.cyclic_shift(a, (0, 0))):
        for row in r.df.collect():
            x, y = (round(c) for c in a.geometry.to_index(r.geometry.to_point([row[k] for k in r.axes])))
            assert row.v == y * 6 + x
    turned = geometry.permute_axes(a, (1, 0))
    assert turned.geometry.size == (4, 6) and np.array_equal(array(turned), array(a).T)


@pytest.mark.parametrize("rule", list(reduce.RULES))
def test_thresholds_part_two_modes(spark, rule):
    a = np.concatenate((rng.normal(60, 6, 700), rng.normal(180, 9, 500))).round().clip(0, 255).reshape(30, 40)
    r = raster(spark, a, "uint8")
    try:
        t = reduce.histogram_threshold(r, rule)[1].first().threshold
    except Exception as e:
        assert "bimodal" in str(e)
        return
    assert 40 <= t <= 200 and (rule not in ("otsu", "isodata", "li", "huang", "kittler_illingworth", "moments") or 75 < t < 160)


def test_constant_image(spark):
    r = raster(spark, np.full((3, 4), 7.0))
    h = reduce.histogram(r, 8).where("count > 0").collect()
    assert [(x.bin, x["count"]) for x in h] == [(7, 12)]
    assert array(window.median(r, (1, 1))).tolist() == [[7.0] * 4] * 3
    assert reduce.statistics(r).first().variance == 0


def test_three_dimensions(spark):
    a = rng.integers(0, 9, (4, 5, 6)).astype(float)
    r = raster(spark, a)
    pad = np.pad(a, 1, mode="edge")
    want = np.mean([pad[i : i + 4, j : j + 5, k : k + 6] for i in range(3) for j in range(3) for k in range(3)], axis=0)
    assert np.allclose(array(window.mean(r, (1, 1, 1))), want)
    mask = raster(spark, (a > 5).astype(float), "uint8")
    got = array(labels.connected_component(mask))
    seen, n = np.zeros_like(a), 0
    for start in zip(*np.nonzero(a > 5)):
        if not seen[start]:
            n += 1
            todo = [start]
            while todo:
                p = todo.pop()
                if all(0 <= c < s for c, s in zip(p, a.shape)) and a[p] > 5 and not seen[p]:
                    seen[p] = n
                    todo += [tuple(np.add(p, o)) for o in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    assert np.array_equal(got, seen)


def brute_reconstruction(marker, mask):
    now = np.minimum(marker, mask)
    while True:
        p = np.pad(now, 1, constant_values=-np.inf)
        new = np.minimum(mask, np.max([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]], axis=0))
        if np.array_equal(new, now):
            return now
        now = new


def test_reconstruction(spark):
    a = rng.integers(0, 40, (9, 11)).astype(float)
    r = raster(spark, a)
    assert np.array_equal(array(morphology.h_maxima(r, 9)), brute_reconstruction(a - 9, a))
    assert np.array_equal(array(morphology.h_minima(r, 9)), -brute_reconstruction(-a - 9, -a))


def test_gaussians_keep_constants_and_moments(spark):
    impulse = np.zeros((1, 41))
    impulse[0, 20] = 1
    r = raster(spark, impulse)
    x = np.arange(41) - 20
    for out, variance in ((lines.discrete_gaussian(r, 4.0, 1e-4), 4.0), (lines.smooth_gaussian(r, 2.0), 4.0), (lines.recursive_gaussian(r, 2.0, "x"), 4.0)):
        v = array(out)[0]
        assert v.sum() == pytest.approx(1, abs=1e-6) and (v * x * x).sum() == pytest.approx(variance, rel=0.05)
    ramp = raster(spark, np.tile(3.0 * np.arange(41), (1, 1)))
    assert array(lines.recursive_gaussian(ramp, 1.5, "x", 1))[0, 20] == pytest.approx(3, abs=1e-6)


def test_fourier_matches_numpy(spark):
    a = rng.normal(size=(6, 5))
    f = lines.forward_fft(raster(spark, a)).df.toPandas()
    got = np.zeros((6, 5), complex)
    for row in f.itertuples():
        got[row.y, row.x] = row.v["re"] + 1j * row.v["im"]
    assert np.allclose(got, np.fft.fft2(a))


def test_fast_marching_in_even_medium(spark):
    t = array(growing.fast_marching(raster(spark, np.ones((9, 9))), [(0, 0)]))
    assert t[0, 8] == pytest.approx(8) and 8 * 2**0.5 <= t[8, 8] < 13


def test_watershed_parts_two_basins(spark):
    x = np.arange(21)
    a = np.tile(np.minimum((x - 4) ** 2, (x - 15) ** 2).astype(float), (3, 1))
    w = array(growing.watershed(raster(spark, a)))
    assert set(w[1, :9]) == {1} and set(w[1, 11:]) == {2}


def test_registration_finds_a_shift(spark):
    g = Geometry((20, 20))
    fixed, moving = (generators.gaussian_source(spark, g, (4, 4), m, 100) for m in ((9, 10), (11, 9)))
    at, value = registration.register_translation(fixed, moving)
    assert at == pytest.approx((2, -1), abs=0.2) and value < 2
    assert registration.centred_initializer(fixed, moving).translation == pytest.approx((2, -1), abs=0.6)


def test_transforms_invert_and_chain():
    t = resample.euler_2d(0.3, (1, 2), (4, 5)).then(resample.scale((2, 3)))
    assert t.inverse().point(t.point((7, -2))) == pytest.approx((7, -2))
    half = resample.versor_3d((0, 0, np.sin(0.25)))
    assert half.point((1, 0, 0)) == pytest.approx(resample.euler_3d((0, 0, 0.5)).point((1, 0, 0)))


@pytest.mark.parametrize("name", list(images.FORMATS))
def test_image_files(spark, tmp_path, name):
    a = rng.integers(0, 250, (5, 7) if name == "png" else (3, 5, 7)).astype(float)
    pixel = "uint8" if name == "png" else "int16"
    where = {} if name == "png" else {"spacing": (2.0, 0.5, 1.0), "origin": (-1.0, 3.0, 2.0)}
    r = raster(spark, a, pixel, **where)
    for k in range(2):
        (tmp_path / f"i{k}.{name}").write_bytes(images.encode(r, name).first().content)
    back = images.read_images(spark, str(tmp_path))
    assert back.pixel is PIXELS[pixel] and back.geometry.congruent(r.geometry)
    assert back.df.groupBy("image_id").agg(F.sum("v").alias("s")).where(F.col("s") == float(a.sum())).count() == 2
    assert images.read_series(spark, str(tmp_path)).geometry.size[-1] == 2


def test_noise_is_repeatable_and_has_its_moments(spark):
    r = raster(spark, np.full((60, 60), 10.0))
    a = array(noise.additive_gaussian_noise(r, 2.0, 1.0, 7))
    again = noise.additive_gaussian_noise(type(r)(r.df.repartition(7), r.geometry, r.pixel), 2.0, 1.0, 7)
    assert np.array_equal(a, array(again)) and a.mean() == pytest.approx(11, abs=0.15) and a.std() == pytest.approx(2, abs=0.1)


def test_published_test_volume(spark):
    v = generators.xorshift_volume(spark, (4, 2, 1)).df.orderBy("y", "x").limit(5).toPandas()["v"].astype(int).tolist()
    assert v == [59, 641, 384, 121, 923]


def test_interpolators_reproduce_smooth_rasters(spark):
    x = np.arange(24)
    a = raster(spark, np.tile(np.sin(x / 4), (1, 1)))
    points = spark.createDataFrame([(0, k, 8 + k / 10) for k in range(60)], "image_id long, point_id long, p double")
    for name, error in {"linear": 0.01, "bspline": 1e-4, "lanczos": 5e-3, "hamming": 5e-3, "welch": 5e-3, "cosine": 5e-3, "blackman": 5e-3, "gaussian": 0.05}.items():
        for row in resample.sample(a, points, [F.col("p"), F.lit(0.0)], name).collect():
            assert row.s == pytest.approx(np.sin(row.p / 4), abs=error), name


@pytest.mark.parametrize("name", ["gradient_descent", "amoeba", "powell", "one_plus_one"])
def test_optimizers_find_a_minimum(name):
    at, value = getattr(optimizers, name)(lambda p: (p[0] - 1.5) ** 2 + 2 * (p[1] + 0.5) ** 2 + 0.3 * p[0] * p[1], (0.0, 0.0), **({"rate": 0.2} if name == "gradient_descent" else {"rounds": 400} if name == "one_plus_one" else {}))
    best = np.linalg.solve([[2, 0.3], [0.3, 4]], [3, -2])
    assert at == pytest.approx(tuple(best), abs=0.05)


def test_transform_text_round_trip():
    t = resample.euler_2d(0.3, (1, 2), (4, 5))
    assert resample.read_transform(resample.write_transform(t)).point((7, 8)) == pytest.approx(t.point((7, 8)))


def test_thinning_keeps_one_component(spark):
    a = np.zeros((9, 15))
    a[2:7, 1:14] = 1
    thin = array(morphology.binary_thinning(raster(spark, a, "uint8")))
    assert 0 < thin.sum() < 16 and (thin <= a).all()
    assert array(labels.connected_component(raster(spark, thin, "uint8"), True)).max() == 1


def levels_of_area(a, area):
    """For each voxel the highest level whose face-connected component of levels above holds ``area`` voxels."""
    out = np.full(a.shape, a.min())
    for t in np.unique(a):
        left = {tuple(i) for i in np.argwhere(a >= t)}
        while left:
            todo = part = [left.pop()]
            while todo:
                near = {n for y, x in todo for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)) if n in left}
                left -= near
                todo = list(near)
                part = part + todo
            if len(part) >= area:
                for i in part:
                    out[i] = t
    return out


def test_area_opening_meets_levels(spark):
    a = rng.integers(0, 4, (5, 6)).astype(float)
    assert np.array_equal(array(morphology.area_opening(raster(spark, a), 3)), levels_of_area(a, 3))
    assert np.array_equal(array(morphology.area_closing(raster(spark, a, "uint8"), 3)), -levels_of_area(-a, 3))


def test_smooth_and_local_metrics(spark):
    a, b = rng.random((7, 8)), rng.random((7, 8))
    f, m, still = raster(spark, a), raster(spark, b), resample.identity(2)
    bins = 12
    place = lambda v: (v - v.min()) / ((v.max() - v.min()) / (bins - 4)) + 2
    i, at = np.clip(np.floor(place(a)), 2, bins - 3).astype(int), place(b)
    d = np.abs(at[..., None] - np.arange(bins))
    w = np.where(d < 1, (4 - 6 * d**2 + 3 * d**3) / 6, np.where(d < 2, (2 - d) ** 3 / 6, 0))
    p = np.zeros((bins, bins))
    np.add.at(p, i.ravel(), w.reshape(-1, bins))
    p /= p.sum()
    terms = p * np.log(np.where(p > 0, p, 1) / np.where(p > 0, p.sum(1, keepdims=True) * p.sum(0), 1))
    got = registration.mattes(f, m, still, bins).first()
    assert got.value == pytest.approx(-terms.sum(), abs=1e-9) and got.points == a.size
    local = []
    for y in range(7):
        for x in range(8):
            box = np.s_[max(y - 1, 0) : y + 2, max(x - 2, 0) : x + 3]
            local.append(np.corrcoef(a[box].ravel(), b[box].ravel())[0, 1] ** 2)
    got = registration.neighborhood_correlation(f, m, still, (2, 1)).first()
    assert got.value == pytest.approx(-np.mean(local), abs=1e-9) and got.points == a.size
    assert registration.neighborhood_correlation(f, raster(spark, 2 * a + 3), still, (1, 1)).first().value == pytest.approx(-1)
