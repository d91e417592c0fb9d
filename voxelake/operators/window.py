"""Neighbourhood filters.

``taps`` gives each voxel the array of its neighbourhood's values, built axis by axis from
window frames over lines: no voxel is copied to its neighbours through a shuffle, and the
filters are expressions on the array.  Box sums of any radius use running frames instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..raster import PIXELS, Raster


def taps(r: Raster, radius: Sequence[int], border: str = "clamp", constant: float | None = None) -> Raster:
    """A raster whose ``v`` is the array of values in the box of ``radius``, x fastest.

    border: ``clamp`` repeats the edge, ``crop`` leaves outside values out, ``constant``
    takes a constant, ``null`` keeps them null.
    """
    df = r.df.select(*r.keys, F.array(F.col("v")).alias("v"))
    outside = None if constant is None else r.pixel.saturate(F.lit(float(constant)))
    for a, k in zip(r.axes, radius):
        if not k:
            continue
        line = r.line(a)
        whole = line.rowsBetween(-r.size(a), r.size(a))
        edge = lambda o: F.first("v").over(whole) if o < 0 else F.last("v").over(whole)  # noqa: B023, E731
        blank = F.transform("v", lambda x: outside if border == "constant" else F.lit(None).cast(r.pixel.spark))

        def near(o: int) -> Column:
            got = F.col("v") if not o else F.lag("v", -o).over(line) if o < 0 else F.lead("v", o).over(line)  # noqa: B023
            return F.coalesce(got, edge(o) if border == "clamp" else blank) if o else got  # noqa: B023

        df = df.select(*r.keys, F.concat(*[near(o) for o in range(-k, k + 1)]).alias("v"))
    if border == "crop":
        df = df.withColumn("v", F.filter("v", lambda x: x.isNotNull()))
    return Raster(df, r.geometry, r.pixel, r.meta)


def _filter(r: Raster, radius: Sequence[int], fn: Callable[[Column], Column], border: str = "clamp", pixel: str | None = None, constant: float | None = None) -> Raster:
    p = PIXELS[pixel] if pixel else r.pixel
    rows = taps(r, radius, border, constant).df
    return Raster(rows.select(*r.keys, p.saturate(fn(F.col("v"))).alias("v")), r.geometry, p, r.meta)


#: Voxels of a block that one kernel call works on, without the voxels around it.
BLOCK_VOXELS = 1 << 17


def blocks(r: Raster, radius: Sequence[int], kernel: Callable[[np.ndarray], np.ndarray], border: str = "clamp", pixel: str | None = None) -> Raster:
    """A neighbourhood filter as a NumPy kernel on dense blocks, with one shuffle for all axes.

    The kernel gets a block (axes x, y, z) with ``radius`` voxels around it on every side and
    returns the block's new values.  Voxels outside the grid repeat the edge (``clamp``) or
    are NaN (``nan``).  Voxels near a block's border are sent to the blocks behind it too.
    64-bit integers beyond 2**53 do not fit NumPy's doubles: use ``taps`` for them.
    """
    p, dim = PIXELS[pixel] if pixel else r.pixel, r.dim
    side, size, axes = max(2, round(BLOCK_VOXELS ** (1 / dim))), r.geometry.size, r.axes
    tile = lambda c: F.floor(c / side).cast("int")
    rows = r.df.select(*r.keys, F.col("v").cast("double").alias("v"))
    for a, k in zip(axes, radius):
        here = tile(F.col(a)) if not k else F.explode(F.sequence(tile(F.greatest(F.col(a) - k, F.lit(0))), tile(F.least(F.col(a) + k, F.lit(r.size(a) - 1)))))
        rows = rows.withColumn(f"tile_{a}", here)

    def run(block: pa.Table) -> pa.Table:
        low = [block.column(f"tile_{a}")[0].as_py() * side for a in axes]
        high = [min(lo + side, n) for lo, n in zip(low, size)]
        first = [max(lo - k, 0) for lo, k in zip(low, radius)]
        last = [min(hi + k, n) for hi, k, n in zip(high, radius, size)]
        dense = np.full([z - a for a, z in zip(first, last)], np.nan)
        dense[tuple(block.column(a).to_numpy() - lo for a, lo in zip(axes, first))] = block.column("v").to_numpy()
        around = [(f - (lo - k), hi + k - z) for f, z, lo, hi, k in zip(first, last, low, high, radius)]
        new = kernel(np.pad(dense, around, mode="edge") if border == "clamp" else np.pad(dense, around, constant_values=np.nan))
        image = pa.array(np.full(new.size, block.column("image_id")[0].as_py(), np.int64))
        at = [pa.array((i + lo).ravel().astype(np.int32)) for i, lo in zip(np.indices(new.shape), low)]
        return pa.Table.from_arrays([image, *at, pa.array(new.ravel().astype(float))], names=["image_id", *axes, "v"])

    done = rows.groupBy("image_id", *[f"tile_{a}" for a in axes]).applyInArrow(run, "image_id long, " + ", ".join(f"{a} int" for a in axes) + ", v double")
    return Raster(done.select(*r.keys, p.saturate(F.col("v")).alias("v")), r.geometry, p, r.meta)


def exact_in_double(r: Raster) -> bool:
    return r.pixel.name not in ("int64", "uint64")


def _views(block: np.ndarray, radius: Sequence[int]) -> np.ndarray:
    """Every voxel's box, x fastest, as the last axis; a view is copied only where it is used."""
    shape = [2 * k + 1 for k in radius]
    boxes = np.lib.stride_tricks.sliding_window_view(block, shape)
    dim = block.ndim
    return boxes.transpose([*range(dim), *reversed(range(dim, 2 * dim))]).reshape(*boxes.shape[:dim], -1)


def _total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda s, x: s + x.cast("double"))


def box_sum(r: Raster, radius: Sequence[int], border: str = "crop", square: bool = False) -> Raster:
    """Sums over boxes (of squares with ``square``) by running frames, one for each axis.  ``clamp``
    counts the edge voxel again for each voxel outside."""
    df = r.df.select(*r.keys, (F.pow(F.col("v").cast("double"), 2) if square else F.col("v").cast("double")).alias("v"))
    for a, k in zip(r.axes, radius):
        line, last = r.line(a), r.size(a) - 1
        total = F.sum("v").over(line.rowsBetween(-k, k))
        if border == "clamp":
            whole = line.rowsBetween(-last - 1, last + 1)
            total = total + F.greatest(F.lit(0), k - F.col(a)) * F.first("v").over(whole) + F.greatest(F.lit(0), F.col(a) + k - last) * F.last("v").over(whole)
        df = df.withColumn("v", total)
    return Raster(df, r.geometry, PIXELS["float64"], r.meta)


def _box_count(r: Raster, radius: Sequence[int]) -> Column:
    """Voxels of the box that are inside the grid."""
    sides = [F.least(F.col(a) + k, F.lit(r.size(a) - 1)) - F.greatest(F.col(a) - k, F.lit(0)) + 1 for a, k in zip(r.axes, radius)]
    return reduce(lambda x, y: x * y, sides)


def mean(r: Raster, radius: Sequence[int]) -> Raster:
    """Box mean with a repeated edge."""
    n = math.prod(2 * k + 1 for k in radius)
    if not exact_in_double(r):
        return Raster(box_sum(r, radius, "clamp").df.withColumn("v", r.pixel.saturate(F.col("v") / n)), r.geometry, r.pixel)

    def kernel(block: np.ndarray) -> np.ndarray:
        for k, m in enumerate(radius):
            parts = [block[tuple(slice(i, block.shape[k] - 2 * m + i) if j == k else slice(None) for j in range(block.ndim))] for i in range(2 * m + 1)]
            block = reduce(lambda x, y: x + y, parts)
        return block / n

    return blocks(r, radius, kernel)


def box_mean(r: Raster, radius: Sequence[int]) -> Raster:
    """Mean of the voxels of the box that are inside the grid."""
    return Raster(box_sum(r, radius).df.withColumn("v", r.pixel.saturate(F.col("v") / _box_count(r, radius))), r.geometry, r.pixel)


def box_sigma(r: Raster, radius: Sequence[int]) -> Raster:
    """Sample deviation of the voxels of the box that are inside the grid."""
    both = box_sum(r, radius).zip(box_sum(r, radius, square=True))
    n = _box_count(r, radius)
    variance = F.greatest((F.col("v1") - F.col("v0") * F.col("v0") / n) / (n - 1), F.lit(0.0))
    return Raster(both.select(*r.keys, F.sqrt(variance).alias("v")), r.geometry, PIXELS["float64"])


def median(r: Raster, radius: Sequence[int]) -> Raster:
    n = math.prod(2 * k + 1 for k in radius)
    if not exact_in_double(r):
        return _filter(r, radius, lambda w: F.element_at(F.sort_array(w), n // 2 + 1))
    return blocks(r, radius, lambda b: np.partition(_views(b, radius), n // 2, axis=-1)[..., n // 2])


def rank(r: Raster, radius: Sequence[int], quantile: float = 0.5) -> Raster:
    """Order statistic of the voxels of the box inside the grid."""
    if not exact_in_double(r):
        return _filter(r, radius, lambda w: F.element_at(F.sort_array(w), (F.floor(quantile * (F.size(w) - 1) + 0.5) + 1).cast("int")), "crop")

    def kernel(block: np.ndarray) -> np.ndarray:
        boxes = np.sort(_views(block, radius), axis=-1)  # NaN, outside the grid, sorts last
        inside = (~np.isnan(boxes)).sum(-1)
        at = np.floor(quantile * (inside - 1) + 0.5).astype(np.int64)
        return np.take_along_axis(boxes, at[..., None], -1)[..., 0]

    return blocks(r, radius, kernel, "nan")


def fast_approximate_rank(r: Raster, radius: Sequence[int], quantile: float = 0.5) -> Raster:
    """The rank along each axis in turn."""
    for k, n in enumerate(radius):
        r = rank(r, [n if j == k else 0 for j in range(r.dim)], quantile)
    return r


def noise(r: Raster, radius: Sequence[int]) -> Raster:
    """Sample deviation of the box, with a repeated edge."""
    n = math.prod(2 * k + 1 for k in radius)

    def sigma(w: Column) -> Column:
        m = _total(w) / n
        return F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / (n - 1))

    return _filter(r, radius, sigma, pixel="float64")


def _axis_taps(r: Raster, axis: str, offsets: Sequence[int]) -> list[Column]:
    """Values at offsets along an axis, with a repeated edge."""
    line = r.line(axis)
    whole = line.rowsBetween(-r.size(axis), r.size(axis))
    v = F.col("v").cast("double")
    at = lambda o: v if not o else F.coalesce(F.lag(v, -o).over(line), F.first(v).over(whole)) if o < 0 else F.coalesce(F.lead(v, o).over(line), F.last(v).over(whole))
    return [at(o) for o in offsets]


def _per_axis(r: Raster, value: Callable[[Raster, str, float], Column]) -> tuple:
    """One column for each axis, named g0, g1, ..."""
    df = r.df
    for k, a in enumerate(r.axes):
        df = df.withColumn(f"g{k}", value(r, a, r.geometry.spacing[k]))
    return df, [F.col(f"g{k}") for k in range(r.dim)]


def _central(r: Raster, a: str, spacing: float) -> Column:
    low, high = _axis_taps(r, a, (-1, 1))
    return (high - low) / (2 * spacing)


def gradient_magnitude(r: Raster) -> Raster:
    spacing = r.geometry.spacing

    def kernel(block: np.ndarray) -> np.ndarray:
        inner, square = (slice(1, -1),) * block.ndim, 0.0
        for k, h in enumerate(spacing):
            after, before = (tuple(part if j == k else c for j, c in enumerate(inner)) for part in (slice(2, None), slice(None, -2)))
            square = square + ((block[after] - block[before]) / (2 * h)) ** 2
        return np.sqrt(square)

    return blocks(r, [1] * r.dim, kernel, pixel="float32")


def gradient(r: Raster, use_direction: bool = False) -> Raster:
    """Central differences as a vector pixel, turned into physical axes on request."""
    df, g = _per_axis(r, _central)
    if use_direction:
        g = [reduce(lambda a, b: a + b, [x * d for x, d in zip(g, row)]) for row in r.geometry.direction]
    return Raster(df.select(*r.keys, F.array(*g).alias("v")), r.geometry, PIXELS["float64"])


def derivative(r: Raster, axis: str, order: int = 1) -> Raster:
    """Central derivative of order 1 or 2 along an axis."""
    h = r.geometry.spacing[r.axes.index(axis)]
    low, mid, high = _axis_taps(r, axis, (-1, 0, 1))
    value = (high - low) / (2 * h) if order == 1 else (high - 2 * mid + low) / (h * h)
    return Raster(r.df.select(*r.keys, value.alias("v")), r.geometry, PIXELS["float64"])


def laplacian(r: Raster) -> Raster:
    def second(r: Raster, a: str, h: float) -> Column:
        low, mid, high = _axis_taps(r, a, (-1, 0, 1))
        return (high - 2 * mid + low) / (h * h)

    df, g = _per_axis(r, second)
    return Raster(df.select(*r.keys, reduce(lambda a, b: a + b, g).alias("v")), r.geometry, PIXELS["float64"])


def convolve(r: Raster, weights: Sequence[float], radius: Sequence[int], border: str = "clamp") -> Raster:
    """Weighted sum of the box, weights in raster order."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return _filter(r, radius, lambda t: F.aggregate(F.zip_with(t, w, lambda x, k: x.cast("double") * k), F.lit(0.0), lambda s, x: s + x), border, "float64")


def sobel_edge_detection(r: Raster) -> Raster:
    """Norm of the Sobel operators of all axes."""
    parts = []
    for a in range(r.dim):
        kernel = [1.0]
        for k in reversed(range(r.dim)):
            kernel = [x * y for x in kernel for y in ((-1, 0, 1) if k == a else (1, 2, 1))]
        parts.append(convolve(r, kernel, [1] * r.dim))
    total = reduce(lambda a, b: a + b, [F.col(f"v{k}") * F.col(f"v{k}") for k in range(r.dim)])
    return Raster(parts[0].zip(*parts[1:]).select(*r.keys, F.sqrt(total).alias("v")), r.geometry, PIXELS["float64"])


def zero_crossing(r: Raster, foreground: int = 1, background: int = 0) -> Raster:
    """Marks a voxel whose sign differs from an axis neighbour's if it is nearer to zero (in a tie,
    the later one of the two)."""
    v = F.col("v").cast("double")
    marks = []
    df = r.df
    for k, a in enumerate(r.axes):
        for o in (-1, 1):
            n = F.lag(v, 1).over(r.line(a)) if o < 0 else F.lead(v, 1).over(r.line(a))
            name = f"n{k}{o + 1}"
            df = df.withColumn(name, n)
            c = F.col(name)
            differs = ((v < 0) & (c > 0)) | ((v > 0) & (c < 0)) | ((v == 0) & (c != 0)) | ((v != 0) & (c == 0))
            marks.append(F.coalesce(differs & ((F.abs(v) < F.abs(c)) | ((F.abs(v) == F.abs(c)) & F.lit(o < 0))), F.lit(False)))
    return r.with_rows(df.withColumn("v", F.when(reduce(lambda a, b: a | b, marks), foreground).otherwise(background)), pixel="uint8")


def laplacian_sharpening(r: Raster) -> Raster:
    """Input minus its Laplacian rescaled to the input's range, brought back to the input's mean and
    held in its range."""
    from .reduce import statistics

    real = r.map(lambda v: v.cast("double"), "float64")
    lap = laplacian(r)
    own, its = statistics(real).select("image_id", *[F.col(c).alias(f"i_{c}") for c in ("minimum", "maximum", "mean")]), statistics(lap).select("image_id", *[F.col(c).alias(f"l_{c}") for c in ("minimum", "maximum")])
    span = F.when(F.col("l_maximum") == F.col("l_minimum"), F.lit(1.0)).otherwise(F.col("l_maximum") - F.col("l_minimum"))
    scaled = (F.col("v1") - F.col("l_minimum")) * ((F.col("i_maximum") - F.col("i_minimum")) / span) + F.col("i_minimum")
    rows = real.zip(lap).join(own, "image_id").join(its, "image_id").select(*r.keys, (F.col("v0") - scaled).alias("v"), "i_minimum", "i_maximum", "i_mean")
    shift = rows.groupBy("image_id").agg(F.avg("v").alias("m"))
    value = F.least(F.greatest(F.col("v") - F.col("m") + F.col("i_mean"), F.col("i_minimum")), F.col("i_maximum"))
    return Raster(rows.join(shift, "image_id").select(*r.keys, value.alias("v")), r.geometry, PIXELS["float64"])


def bilateral(r: Raster, radius: Sequence[int], domain_sigma: float, range_sigma: float) -> Raster:
    """Means weighted by distance in space and in value, repeated edge."""
    boxes = [[]]
    for k in reversed(range(r.dim)):
        boxes = [[*b, (o * r.geometry.spacing[k]) ** 2] for b in boxes for o in range(-radius[k], radius[k] + 1)]
    space = F.array(*[F.lit(math.exp(-sum(b) / (2 * domain_sigma**2))) for b in boxes])
    centre = F.element_at(F.col("v"), len(boxes) // 2 + 1).cast("double")

    def weighted(w: Column) -> Column:
        pairs = F.zip_with(w, space, lambda x, s: F.struct(x.cast("double").alias("x"), (s * F.exp(-F.pow(x.cast("double") - centre, 2) / (2 * range_sigma**2))).alias("k")))
        sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, p: F.struct((s["a"] + p["x"] * p["k"]).alias("a"), (s["b"] + p["k"]).alias("b")))
        return sums["a"] / sums["b"]

    return _filter(r, radius, weighted, pixel="float64")


def normalized_correlation(r: Raster, template: Sequence[float], radius: Sequence[int]) -> Raster:
    """Correlation of each box with a template in raster order (0 for constant boxes)."""
    n = len(template)
    m = sum(template) / n
    unit = [t - m for t in template]
    norm = math.sqrt(sum(t * t for t in unit))
    weights = F.array(*[F.lit(t / norm) for t in unit])

    def ncc(w: Column) -> Column:
        dot = F.aggregate(F.zip_with(w, weights, lambda x, k: x.cast("double") * k), F.lit(0.0), lambda s, x: s + x)
        mu = _total(w) / n
        dev = F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + (x.cast("double") - mu) * (x.cast("double") - mu)))
        return F.when(dev > 0, dot / dev).otherwise(0.0)

    return _filter(r, radius, ncc, pixel="float64")


def box_tap(dim: int) -> Callable[..., Column]:
    """The value at an offset of the 3-box that ``taps`` with radius 1 leaves in ``v``."""
    return lambda *o: F.element_at("v", sum((k + 1) * 3**i for i, k in enumerate(o)) + 1)


def curvature_terms(dim: int) -> tuple[Column, Column]:
    """Over the 3-box in ``v``: squared gradient norm, and curvature times its cube by central
    differences, in any dimension."""
    t = box_tap(dim)

    def off(**at: int) -> Column:
        return t(*(at.get(f"a{i}", 0) for i in range(dim)))

    d = [(off(**{f"a{i}": 1}) - off(**{f"a{i}": -1})) / 2 for i in range(dim)]
    square = reduce(lambda x, y: x + y, [x * x for x in d])
    bend = F.lit(0.0)
    for i in range(dim):
        bend = bend + (off(**{f"a{i}": 1}) - 2 * off() + off(**{f"a{i}": -1})) * (square - d[i] * d[i])
        for j in range(i):
            mixed = (off(**{f"a{i}": 1, f"a{j}": 1}) - off(**{f"a{i}": -1, f"a{j}": 1}) - off(**{f"a{i}": 1, f"a{j}": -1}) + off(**{f"a{i}": -1, f"a{j}": -1})) / 4
            bend = bend - 2 * d[i] * d[j] * mixed
    return square, bend


def curvature_speed(dim: int) -> Column:
    """Curvature times gradient norm over the 3-box in ``v``; 0 where the raster is flat."""
    square, bend = curvature_terms(dim)
    return F.when(square < 1e-12, 0.0).otherwise(bend / F.when(square < 1e-12, 1.0).otherwise(square))


def plane_only(r: Raster, name: str) -> None:
    if r.dim != 2:
        raise ValueError(f"{name} takes two dimensions, not {r.dim}")


def curvature_flow(r: Raster, time_step: float = 0.05, iterations: int = 2) -> Raster:
    """Explicit steps of curvature times gradient norm, in any dimension; staged each round."""
    from ..staging import staged

    now = r.map(lambda v: v.cast("double"), "float64")
    centre = box_tap(r.dim)(*[0] * r.dim)
    for _ in range(iterations):
        w = taps(now, [1] * r.dim).df
        now = now.with_rows(staged(w.select(*r.keys, (centre + time_step * curvature_speed(r.dim)).alias("v"))))
    return now
