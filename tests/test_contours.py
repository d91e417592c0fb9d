"""Contour lines against a sequential chaining of segments."""

import itertools

import numpy as np
import pytest

from voxelake.operators import contours
from voxelake.raster import Geometry, from_table

rng = np.random.default_rng(17)


def chained(a, value, connect_high, reverse):
    """Segments in raster order, each joined to the lines that end where it begins or begin where it ends."""
    lines, n = {}, 0
    for y, x in itertools.product(range(a.shape[1] - 1), range(a.shape[0] - 1)):
        v = [a[x, y], a[x + 1, y], a[x, y + 1], a[x + 1, y + 1]]
        cut = lambda i, j: (value - v[i]) / (v[j] - v[i])  # noqa: B023, E731
        at = {"t": lambda: (x + cut(0, 1), float(y)), "b": lambda: (x + cut(2, 3), y + 1.0), "l": lambda: (float(x), y + cut(0, 2)), "r": lambda: (x + 1.0, y + cut(1, 3))}  # noqa: B023
        square = sum(2**k for k in range(4) if v[k] > value)
        for way in (contours.JOINED if connect_high and square in contours.JOINED else contours.SIDES).get(square, []):
            p, q = at[way[0]](), at[way[1]]()
            if p == q:
                continue
            tail = next((k for k, line in lines.items() if line[-1] == p and line[0] != p), None)
            head = next((k for k, line in lines.items() if line[0] == q and line[-1] != q), None)
            if tail is not None and tail == head:
                lines[tail].append(q)
            elif tail is not None and head is not None:
                low = min(tail, head)
                lines[low] = lines.pop(tail) + lines.pop(head) if tail != head else None
                lines = dict(sorted(lines.items()))
            elif tail is not None:
                lines[tail].append(q)
            elif head is not None:
                lines[head].insert(0, p)
            else:
                lines[n] = [p, q]
                n += 1
    return [line[::-1] if reverse else line for _, line in sorted(lines.items())]


def raster(spark, *arrays, pixel="float64"):
    rows = [(i, x, y, float(a[x, y])) for i, a in enumerate(arrays) for x in range(a.shape[0]) for y in range(a.shape[1])]
    return from_table(spark.createDataFrame(rows, "image_id long, x int, y int, v double").repartition(3), Geometry(arrays[0].shape), pixel)


def lines_of(df, image=0):
    found = {}
    for row in sorted(df.where(f"image_id = {image}").collect(), key=lambda t: (t.contour, t.position)):
        found.setdefault(row.contour, []).append((row.position, (row.x, row.y)))
    assert sorted(found) == list(range(len(found)))
    assert all([p for p, _ in line] == list(range(len(line))) for line in found.values())
    return [[q for _, q in found[k]] for k in sorted(found)]


@pytest.mark.parametrize("connect_high,reverse", [(False, True), (True, False)])
def test_lines_meet_sequential_chaining(spark, connect_high, reverse):
    smooth = rng.normal(0, 1, (14, 12))
    images = [smooth, np.where(np.hypot(*np.indices((14, 12)) - 6) < 4, 5.0, 0.0)]
    got = contours.contour_lines(raster(spark, *images), 0.25, connect_high, reverse)
    for i, a in enumerate(images):
        found, want = lines_of(got, i), chained(a, 0.25, connect_high, reverse)
        assert len(found) == len(want)
        for f, w in zip(found, want):
            assert np.allclose(f, w)
        assert any(w[0] == w[-1] for w in want)


def test_long_line_and_plateaus(spark):
    """A comb makes one line of hundreds of segments; whole numbers hit the value itself."""
    comb = np.zeros((26, 12))
    comb[1:25, 1] = comb[1:25:2, 1:10] = 2
    (line,) = lines_of(contours.contour_lines(raster(spark, comb), 1.0))
    (want,) = chained(comb, 1.0, False, False)
    assert len(line) > 200 and np.allclose(line, want) and line[0] == line[-1]
    steps = np.array([[0, 0, 0, 0], [0, 2, 1, 0], [0, 1, 2, 0], [0, 0, 0, 0]], float)
    for value in (1.0,):
        for found in lines_of(contours.contour_lines(raster(spark, steps), value)):
            assert len(found) > 1 and all(p != q for p, q in zip(found, found[1:]))


def test_whole_values_flat_images_and_refusal(spark):
    a = np.array([[0, 0, 0], [0, 9, 0], [0, 0, 0]], float)
    assert lines_of(contours.contour_lines(raster(spark, a, pixel="uint8"), 4.9)) == [[tuple(map(pytest.approx, p)) for p in chained(a, 4, False, False)[0]]]
    assert contours.contour_lines(raster(spark, a * 0), 0.5).count() == 0 == contours.contour_lines(from_table(raster(spark, a).df.limit(0), Geometry((3, 3))), 0.5).count()
    with pytest.raises(ValueError):
        contours.contour_lines(from_table(spark.createDataFrame([(0, 0, 0, 0, 1.0)], "image_id long, x int, y int, z int, v double"), Geometry((1, 1, 1))), 0.5)
