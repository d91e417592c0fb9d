"""Index remaps: cropping, padding, flipping, resampling by integer factors, pasting and stacking.

Most are filters and arithmetic on the index columns, without a shuffle; pads build the
larger grid and join the source by its remapped index.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..raster import AXES, Geometry, Raster, grid


def region_of_interest(r: Raster, index: Sequence[int], size: Sequence[int]) -> Raster:
    """The block of ``size`` voxels that starts at ``index``."""
    inside = reduce(lambda a, b: a & b, [F.col(a).between(i, i + n - 1) for a, i, n in zip(r.axes, index, size)])
    rows = r.df.where(inside).select("image_id", *[(F.col(a) - i).cast("int").alias(a) for a, i in zip(r.axes, index)], "v")
    return r.with_rows(rows, r.geometry.shifted(index, size))


def crop(r: Raster, lower: Sequence[int], upper: Sequence[int]) -> Raster:
    return region_of_interest(r, lower, [n - a - b for n, a, b in zip(r.geometry.size, lower, upper)])


def extract(r: Raster, index: Sequence[int], size: Sequence[int]) -> Raster:
    """A block; an axis of size 0 is taken at its index and drops out."""
    block = region_of_interest(r, index, [n or 1 for n in size])
    keep = [k for k, n in enumerate(size) if n]
    g = block.geometry
    new = Geometry(tuple(g.size[k] for k in keep), tuple(g.spacing[k] for k in keep), tuple(g.origin[k] for k in keep), tuple(tuple(g.direction[i][j] for j in keep) for i in keep))
    return block.with_rows(block.df.select("image_id", *[F.col(AXES[k]).alias(AXES[j]) for j, k in enumerate(keep)], "v"), new)


def flip(r: Raster, axes: Sequence[str]) -> Raster:
    rows = r.df.select("image_id", *[(F.lit(r.size(a) - 1) - F.col(a)).alias(a) if a in axes else F.col(a) for a in r.axes], "v")
    far = [r.size(a) - 1 if a in axes else 0 for a in r.axes]
    g = r.geometry
    direction = tuple(tuple(-d if a in axes else d for a, d in zip(r.axes, row)) for row in g.direction)
    return r.with_rows(rows, Geometry(g.size, g.spacing, g.to_point(far), direction))


def permute_axes(r: Raster, order: Sequence[int]) -> Raster:
    g = r.geometry
    rows = r.df.select("image_id", *[F.col(AXES[k]).alias(AXES[j]) for j, k in enumerate(order)], "v")
    return r.with_rows(rows, Geometry(tuple(g.size[k] for k in order), tuple(g.spacing[k] for k in order), g.origin, tuple(tuple(row[k] for k in order) for row in g.direction)))


def slice_axes(r: Raster, ranges: Sequence[tuple[int, int, int]]) -> Raster:
    """start, stop, step for each axis, as in Python's ranges; a negative step reverses."""
    picks = [range(*s) for s in ranges]
    steps = [(p.step, p[0]) for p in picks]
    inside = reduce(lambda a, b: a & b, [F.col(a).between(min(p), max(p)) & (F.pmod(F.col(a) - p[0], F.lit(abs(p.step))) == 0) for a, p in zip(r.axes, picks)])
    rows = r.df.where(inside).select("image_id", *[((F.col(a) - first) / step).cast("int").alias(a) for a, (step, first) in zip(r.axes, steps)], "v")
    return r.with_rows(rows, r.geometry.shifted([p[0] for p in picks], [len(p) for p in picks], [p.step for p in picks]))


def shrink(r: Raster, factors: Sequence[int]) -> Raster:
    """Every ``f``-th voxel, offset so that the centre of the grid stays."""
    sizes = [max(1, n // f) for n, f in zip(r.geometry.size, factors)]
    offsets = [max(0, int((n - 1) / 2 - f * (m - 1) / 2 + 0.5)) for n, f, m in zip(r.geometry.size, factors, sizes)]
    return slice_axes(r, [(o, min(o + f * (m - 1) + 1, n), f) for o, f, m, n in zip(offsets, factors, sizes, r.geometry.size)])


def bin_shrink(r: Raster, factors: Sequence[int]) -> Raster:
    """Means of whole blocks; integers round half up; an incomplete last block drops out."""
    sizes = [n // f for n, f in zip(r.geometry.size, factors)]
    inside = reduce(lambda a, b: a & b, [F.col(a) < f * m for a, f, m in zip(r.axes, factors, sizes)])
    mean = F.avg(F.col("v").cast("double"))
    rows = r.df.where(inside).groupBy("image_id", *[F.floor(F.col(a) / f).cast("int").alias(a) for a, f in zip(r.axes, factors)]).agg((F.floor(mean + 0.5) if r.pixel.integer else mean).alias("v"))
    centre = [(f - 1) / 2 for f in factors]
    return r.with_rows(rows, r.geometry.shifted(centre, sizes, factors))


def _pad(r: Raster, lower: Sequence[int], upper: Sequence[int], index: dict[str, Column] | None, fill: float | None = None) -> Raster:
    """A grid grown by ``lower`` and ``upper``; ``index`` maps its axes to the source's."""
    g = r.geometry.shifted([-k for k in lower], [n + a + b for n, a, b in zip(r.geometry.size, lower, upper)])
    wide = grid(r.df, g).select("image_id", *r.axes, *[c.cast("int").alias(f"s_{a}") for a, c in index.items()])
    source = r.df.select("image_id", *[F.col(a).alias(f"s_{a}") for a in r.axes], "v")
    rows = wide.join(source, ["image_id", *[f"s_{a}" for a in r.axes]], "left" if fill is not None else "inner")
    if fill is not None:
        rows = rows.withColumn("v", F.coalesce("v", r.pixel.saturate(F.lit(float(fill)))))
    return r.with_rows(rows, g)


def _indices(r: Raster, lower: Sequence[int]) -> dict[str, Column]:
    return {a: F.col(a) - k for a, k in zip(r.axes, lower)}


def constant_pad(r: Raster, lower: Sequence[int], upper: Sequence[int], constant: float = 0) -> Raster:
    return _pad(r, lower, upper, _indices(r, lower), constant)


def mirror_pad(r: Raster, lower: Sequence[int], upper: Sequence[int]) -> Raster:
    """Reflection that repeats the edge voxel (period 2n)."""
    fold = lambda c, n: F.when((p := F.pmod(c, F.lit(2 * n))) < n, p).otherwise(2 * n - 1 - p)
    return _pad(r, lower, upper, {a: fold(c, r.size(a)) for a, c in _indices(r, lower).items()})


def wrap_pad(r: Raster, lower: Sequence[int], upper: Sequence[int]) -> Raster:
    return _pad(r, lower, upper, {a: F.pmod(c, F.lit(r.size(a))) for a, c in _indices(r, lower).items()})


def zero_flux_pad(r: Raster, lower: Sequence[int], upper: Sequence[int]) -> Raster:
    """Growth that repeats the edge."""
    return _pad(r, lower, upper, {a: F.least(F.greatest(c, F.lit(0)), F.lit(r.size(a) - 1)) for a, c in _indices(r, lower).items()})


def cyclic_shift(r: Raster, shift: Sequence[int]) -> Raster:
    rows = r.df.select("image_id", *[F.pmod(F.col(a) + k, F.lit(r.size(a))).cast("int").alias(a) for a, k in zip(r.axes, shift)], "v")
    return r.with_rows(rows)


def fft_shift(r: Raster) -> Raster:
    return cyclic_shift(r, [n // 2 for n in r.geometry.size])


def checker_board(a: Raster, b: Raster, pattern: Sequence[int]) -> Raster:
    """Two rasters on alternate fields of a board with ``pattern`` fields along each axis."""
    fields = [F.floor(F.col(x) / max(1, n // p)) for x, n, p in zip(a.axes, a.geometry.size, pattern)]
    odd = F.pmod(reduce(lambda s, t: s + t, fields), F.lit(2)) == 1
    return a.with_rows(a.zip(b).withColumn("v", F.when(odd, F.col("v1")).otherwise(F.col("v0"))))


def paste(target: Raster, source: Raster, index: Sequence[int]) -> Raster:
    """The source over the target, its first voxel at ``index``."""
    moved = source.df.select("image_id", *[(F.col(a) + k).cast("int").alias(a) for a, k in zip(source.axes, index)], F.col("v").cast(target.pixel.spark).alias("s"))
    return target.with_rows(target.df.join(moved, target.keys, "left").withColumn("v", F.coalesce("s", "v")))


def tile(rasters: Sequence[Raster], axis: str) -> Raster:
    """Rasters side by side along an axis."""
    parts, at = [], 0
    for r in rasters:
        parts.append(r.df.withColumn(axis, (F.col(axis) + at).cast("int")))
        at += r.size(axis)
    first = rasters[0]
    size = tuple(at if a == axis else n for a, n in zip(first.axes, first.geometry.size))
    g = first.geometry
    return first.with_rows(reduce(lambda a, b: a.unionByName(b), parts), Geometry(size, g.spacing, g.origin, g.direction))


def join_series(rasters: Sequence[Raster]) -> Raster:
    """Rasters stacked along a new last axis."""
    first = rasters[0]
    axis = AXES[first.dim]
    rows = reduce(lambda a, b: a.unionByName(b), [r.df.withColumn(axis, F.lit(k)) for k, r in enumerate(rasters)])
    g = first.geometry
    return first.with_rows(rows, Geometry((*g.size, len(rasters)), (*g.spacing, 1.0), (*g.origin, 0.0)))


def expand(r: Raster, factors: Sequence[int]) -> Raster:
    """Integer upsampling by the nearest voxel."""
    rows = r.df
    for a, f in zip(r.axes, factors):
        rows = rows.withColumn(a, F.explode(F.sequence(F.col(a) * f, F.col(a) * f + f - 1)))
    g = r.geometry
    start = [-(f - 1) / (2 * f) for f in factors]
    return r.with_rows(rows, Geometry(tuple(n * f for n, f in zip(g.size, factors)), tuple(s / f for s, f in zip(g.spacing, factors)), g.to_point(start), g.direction))


def to_vector(r: Raster) -> Raster:
    """The first axis as the components of a vector pixel."""
    rest = list(r.axes[1:])
    rows = r.df.groupBy("image_id", *rest).agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("v"))
    rows = rows.select("image_id", *[F.col(b).alias(a) for a, b in zip(AXES, rest)], "v")
    g = r.geometry
    return Raster(rows, Geometry(g.size[1:], g.spacing[1:], g.origin[1:]), r.pixel)


# Orientation: each axis of the grid points to one of left/right, posterior/anterior, superior/inferior.

_TOWARDS = (("L", "R"), ("P", "A"), ("S", "I"))


def orientation_of(direction: Sequence[Sequence[float]]) -> str:
    """Three letters for a direction matrix: where each axis of the grid points (``LPS``: identity).
    The largest cosines are assigned first, each anatomical axis once."""
    m, code = np.array(direction, float), [""] * 3
    free = np.ones((3, 3), bool)
    for _ in range(3):
        i, j = np.unravel_index(np.argmax(np.where(free, np.abs(m), -1)), (3, 3))
        code[j] = _TOWARDS[i][0 if m[i, j] >= 0 else 1]
        free[i, :] = free[:, j] = False
    return "".join(code)


def direction_of(code: str) -> tuple[tuple[float, ...], ...]:
    """The direction matrix of three orientation letters."""
    if len(code) != 3 or sorted(_axis_of(c) for c in code) != [0, 1, 2]:
        raise ValueError(f"{code} names no orientation")
    m = np.zeros((3, 3))
    for j, c in enumerate(code):
        m[_axis_of(c), j] = 1.0 if c == _TOWARDS[_axis_of(c)][0] else -1.0
    return tuple(map(tuple, m.tolist()))


def _axis_of(letter: str) -> int:
    return next((i for i, pair in enumerate(_TOWARDS) if letter in pair), -1)


def dicom_orient(r: Raster, code: str = "LPS") -> tuple[Raster, tuple[int, ...], tuple[str, ...]]:
    """Axes permuted and flipped to the orientation ``code``; the order of the old axes and the
    flipped ones of the new.  Voxels keep their physical points."""
    direction_of(code)
    have = orientation_of(r.geometry.direction)
    order = tuple(next(k for k, c in enumerate(have) if _axis_of(c) == _axis_of(want)) for want in code)
    turned = tuple(a for a, k, want in zip(r.axes, order, code) if have[k] != want)
    out = permute_axes(r, order)
    return flip(out, turned) if turned else out, order, turned
