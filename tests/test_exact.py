"""Integers of 64 bits in neighbour rules, and threshold rules against their definition."""

import math

import numpy as np
import pytest

from voxelake.operators import labels, morphology, reduce
from voxelake.raster import Geometry, from_table

BIG = 2**53


def line(spark, values, pixel="int64"):
    kind = "decimal(20,0)" if pixel == "uint64" else "long"
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "image_id long, x int, v string").selectExpr("image_id", "x", f"cast(v as {kind}) as v")
    return from_table(df, Geometry((len(values),)), pixel)


def values(r):
    return [int(v) for _, v in sorted((row.x, row.v) for row in r.df.collect())]


def test_neighbours_differ_in_the_last_digit(spark):
    for pixel, top in (("int64", 2**63 - 1), ("uint64", 2**64 - 1)):
        r = line(spark, [BIG, BIG + 1, top - 1, top, 0, top], pixel)
        assert values(labels.scalar_connected_component(r)) == [1, 2, 3, 4, 5, 6]
        assert values(labels.scalar_connected_component(r, 1)) == [1, 1, 2, 2, 3, 4]
        assert values(morphology.regional_extrema(r)) == [0, 0, 0, 1, 0, 1]
        assert values(morphology.reconstruction(r, r)) == values(r) == values(morphology.reconstruction(r, r, "erosion"))
        low = line(spark, [0, 0, 0, top, 0, 0], pixel)
        assert values(morphology.reconstruction(low, r)) == [BIG, BIG + 1, top - 1, top, 0, 0]


def test_reconstruction_of_large_integers(spark):
    mask = [BIG + 3, BIG + 5, BIG + 4, -(2**63), 7, -(2**63) + 1]
    marker = [BIG + 3, 0, 0, -(2**63), 6, 5]
    got = values(morphology.reconstruction(line(spark, marker), line(spark, mask)))
    assert got == [BIG + 3, BIG + 3, BIG + 3, -(2**63), 6, -(2**63) + 1]
    got = values(morphology.reconstruction(line(spark, [BIG + 9, BIG + 9, BIG + 4, 2**63 - 1, 7, 8]), line(spark, mask), "erosion"))
    assert got == [BIG + 5, BIG + 5, BIG + 4, 7, 7, 7]


def test_vectors_join_by_angle(spark):
    vectors = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [-1.0, 0.0]]
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(vectors)], "image_id long, x int, v array<double>")
    from voxelake.raster import PIXELS, Raster

    r = Raster(df, Geometry((4,)), PIXELS["float64"])
    assert values(labels.vector_connected_component(r, 0.25)) == [1, 1, 2, 3]


def bins(counts, low, width):
    edge = [low + k * width for k in range(len(counts) + 1)]
    return edge[:-1], edge[1:], counts


def li(b):
    """Each candidate rounded, the split behind its bin, the result the middle of that bin."""
    mid = [(x + y) / 2 for x, y in zip(b[0], b[1])]
    at = lambda v: 0 if v < b[0][0] else len(mid) - 1 if v >= b[1][-1] else max(k for k in range(len(mid)) if b[0][k] <= v)
    shift, t = min(b[0][0], 0), sum(f * m for f, m in zip(b[2], mid)) / sum(b[2])
    while True:
        cut = at(int(t + 0.5))
        part = lambda s: sum(f * m for f, m in zip(b[2][s], mid[s])) / max(sum(b[2][s]), 1) - shift
        back, fore = part(slice(0, cut + 1)), part(slice(cut + 1, None))
        new = (back - fore) / (math.log(back) - math.log(fore))
        new = int(new + 0.5) if new >= 0 else int(new - 0.5)
        if abs(new + shift - t) <= 0.5:
            return mid[cut]
        t = new + shift


def two_modes(n=64):
    x = np.arange(n)
    return (1000 * np.exp(-((x - 15) ** 2) / 40) + 600 * np.exp(-((x - 44) ** 2) / 90)).astype(int).tolist()


def test_thresholds_are_middles_of_bins():
    b = bins(two_modes(), 0.0, 10.0)
    for rule in ("li", "huang", "kittler_illingworth"):
        assert (reduce.RULES[rule](b) - 5) % 10 == pytest.approx(0)
    assert reduce.RULES["li"](b) == li(b) and reduce.RULES["li"](bins(two_modes(), -200.0, 10.0)) == li(bins(two_modes(), -200.0, 10.0))


def test_huang_centres_on_rounded_values():
    """With narrow bins the rounded mean value can lie many bins from the mean bin."""
    b = bins(two_modes(), 0.0, 0.3)
    mid, f = [(x + y) / 2 for x, y in zip(*b[:2])], b[2]
    first, last = (g(k for k in range(64) if f[k]) for g in (min, max))

    def fuzz(t):
        total = 0.0
        for side in (range(first, t + 1), range(t + 1, last + 1)):
            mean = math.floor(sum(mid[k] * f[k] for k in side if k) / sum(f[k] for k in side) + 0.5)
            centre = max((k for k in range(64) if b[0][k] <= mean), default=0)
            for k in side:
                m = 1 / (1 + min(abs(k - centre), last - first) / (last - first))
                total -= (m * math.log(m) + (1 - m) * math.log(1 - m)) * f[k] if m < 1 else 0
        return total

    assert reduce.RULES["huang"](b) == pytest.approx(mid[min(range(first, last), key=fuzz)])


def test_kittler_illingworth_fails_without_spread():
    assert 200 < reduce.RULES["kittler_illingworth"](bins(two_modes(), 0.0, 10.0)) < 350
    with pytest.raises(ValueError):
        reduce.RULES["kittler_illingworth"](bins([5, 0, 0, 0, 7], 0.0, 1.0))


def test_one_value(spark):
    for rule in ("li", "huang"):
        out, found = reduce.histogram_threshold(line(spark, [4, 4, 4]), rule, 16)
        assert found.first().threshold == 4
