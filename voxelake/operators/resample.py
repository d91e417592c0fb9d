"""Spatial transforms, interpolation and resampling.

A transform maps physical points to physical points as column expressions.  Resampling
computes, for every output voxel, a continuous index of the input and deals it to the
tile of input voxels it falls into; a NumPy kernel weighs the voxels around it (one for
nearest, 2**dim for linear, 4**dim for cubic splines, 10**dim for windowed sincs).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..raster import PIXELS, Geometry, Raster, grid


@dataclass(frozen=True)
class Affine:
    """p -> matrix (p - centre) + centre + translation."""

    matrix: tuple[tuple[float, ...], ...]
    translation: tuple[float, ...]
    centre: tuple[float, ...] = ()

    @property
    def offset(self) -> np.ndarray:
        c = np.array(self.centre or (0.0,) * len(self.translation))
        return c + np.array(self.translation) - np.array(self.matrix) @ c

    def columns(self, p: Sequence[Column]) -> list[Column]:
        return [reduce(lambda s, jx: s + p[jx[0]] * float(jx[1]), enumerate(row), F.lit(float(o))) for row, o in zip(self.matrix, self.offset)]

    def point(self, p: Sequence[float]) -> tuple[float, ...]:
        return tuple((np.array(self.matrix) @ np.array(p) + self.offset).tolist())

    def inverse(self) -> Affine:
        m = np.linalg.inv(np.array(self.matrix))
        return Affine(tuple(map(tuple, m.tolist())), tuple((-m @ self.offset).tolist()))

    def then(self, other: Affine) -> Affine:
        """This transform first, then ``other``."""
        m = np.array(other.matrix) @ np.array(self.matrix)
        return Affine(tuple(map(tuple, m.tolist())), tuple((np.array(other.matrix) @ self.offset + other.offset).tolist()))


def _rows(m) -> tuple[tuple[float, ...], ...]:
    return tuple(map(tuple, np.asarray(m, float).tolist()))


def identity(dim: int) -> Affine:
    return Affine(_rows(np.eye(dim)), (0.0,) * dim)


def translation(offset: Sequence[float]) -> Affine:
    return Affine(_rows(np.eye(len(offset))), tuple(map(float, offset)))


def scale(factors: Sequence[float], centre: Sequence[float] = ()) -> Affine:
    return Affine(_rows(np.diag(factors)), (0.0,) * len(factors), tuple(centre))


def euler_2d(angle: float, offset: Sequence[float] = (0, 0), centre: Sequence[float] = (0, 0), factor: float = 1.0) -> Affine:
    """Rotation (with ``factor``: a similarity) about a centre, then a translation."""
    c, s = math.cos(angle) * factor, math.sin(angle) * factor
    return Affine(((c, -s), (s, c)), tuple(map(float, offset)), tuple(map(float, centre)))


def euler_3d(angles: Sequence[float], offset: Sequence[float] = (0, 0, 0), centre: Sequence[float] = (0, 0, 0)) -> Affine:
    """Rotations about x, y, z combined as Rz Rx Ry."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(a), math.sin(a)) for a in angles)
    rx, ry, rz = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]), np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]), np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return Affine(_rows(rz @ rx @ ry), tuple(map(float, offset)), tuple(map(float, centre)))


def similarity_2d(factor: float, angle: float, offset: Sequence[float] = (0, 0), centre: Sequence[float] = (0, 0)) -> Affine:
    """Rotation and scaling about a centre, then a translation."""
    return euler_2d(angle, offset, centre, factor)


def similarity_3d(factor: float, versor: Sequence[float], offset: Sequence[float] = (0, 0, 0), centre: Sequence[float] = (0, 0, 0)) -> Affine:
    """Rotation by a versor and scaling about a centre, then a translation."""
    return Affine(_rows(np.array(versor_3d(versor).matrix) * factor), tuple(map(float, offset)), tuple(map(float, centre)))


def scale_versor_3d(factors: Sequence[float], versor: Sequence[float], offset: Sequence[float] = (0, 0, 0), centre: Sequence[float] = (0, 0, 0)) -> Affine:
    """Rotation matrix with each factor less one added on its diagonal, about a centre, then a translation."""
    return Affine(_rows(np.array(versor_3d(versor).matrix) + np.diag(np.array(factors) - 1.0)), tuple(map(float, offset)), tuple(map(float, centre)))


def scale_logarithmic(logarithms: Sequence[float], centre: Sequence[float] = ()) -> Affine:
    """Scaling by the exponentials of the parameters."""
    return scale([math.exp(x) for x in logarithms], centre)


def composite(transforms: Sequence[Affine]) -> Affine:
    """Transforms of a stack as one: the last of the list is applied first."""
    return reduce(lambda done, t: done.then(t), reversed(transforms))


def versor_3d(versor: Sequence[float], offset: Sequence[float] = (0, 0, 0), centre: Sequence[float] = (0, 0, 0)) -> Affine:
    """Rotation by the unit quaternion with vector part ``versor``."""
    x, y, z = versor
    w = math.sqrt(max(0.0, 1 - x * x - y * y - z * z))
    m = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return Affine(_rows(m), tuple(map(float, offset)), tuple(map(float, centre)))


def point_columns(g: Geometry, axes: Sequence[str]) -> list[Column]:
    """Physical coordinates of the voxel at columns ``axes``."""
    d = len(axes)
    return [reduce(lambda s, j: s + F.col(axes[j]) * (g.direction[i][j] * g.spacing[j]), range(d), F.lit(float(g.origin[i]))) for i in range(d)]


def index_columns(g: Geometry, p: Sequence[Column]) -> list[Column]:
    """Continuous index of a physical point."""
    inverse = np.linalg.inv(np.array(g.direction))
    d = len(p)
    return [reduce(lambda s, j: s + (p[j] - float(g.origin[j])) * float(inverse[i][j]), range(d), F.lit(0.0)) / g.spacing[i] for i in range(d)]


Weight = Callable[[np.ndarray], np.ndarray]


def _sinc(window: Weight) -> tuple[int, Weight]:
    """Windowed sinc of radius 5."""

    def weight(d: np.ndarray) -> np.ndarray:
        centre = np.abs(d) < 1e-12
        d = np.where(centre, 1.0, d)
        return np.where(centre, 1.0, np.where(np.abs(d) >= 5, 0.0, np.sin(np.pi * d) / (np.pi * d) * window(d / 5)))

    return 5, weight


def _cubic(d: Column) -> Column:
    """The cubic B-spline."""
    a = F.abs(d)
    return F.when(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)


def _cubic_weight(d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    return np.where(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6, np.where(a < 2, (2 - a) * (2 - a) * (2 - a) / 6, 0.0))


#: Interpolators as (radius in voxels, weight of a voxel at a distance); ``bspline`` works on coefficients.
KERNELS: dict[str, tuple[int, Weight]] = {
    "linear": (1, lambda d: 1 - np.abs(d)),
    "gaussian": (3, lambda d: np.exp(-d * d / (2 * 0.8**2))),
    "bspline": (2, _cubic_weight),
    "hamming": _sinc(lambda t: 0.54 + 0.46 * np.cos(np.pi * t)),
    "cosine": _sinc(lambda t: np.cos(np.pi * t / 2)),
    "welch": _sinc(lambda t: 1 - t * t),
    "lanczos": _sinc(lambda t: np.sin(np.pi * t) / (np.pi * t)),
    "blackman": _sinc(lambda t: 0.42 + 0.5 * np.cos(np.pi * t) + 0.08 * np.cos(2 * np.pi * t)),
}


def bspline_coefficients(r: Raster) -> Raster:
    """Coefficients whose cubic B-spline passes through the voxels (edges repeated), by solving the
    tridiagonal system of each line along each axis."""
    from .lines import along

    def solve(lines: np.ndarray) -> np.ndarray:
        """Elimination down the diagonal (4, at the ends 5, beside it 1), all lines at once."""
        n = lines.shape[1]
        if n == 1:
            return lines.copy()
        out, beside = np.ascontiguousarray(lines.T) * 6, [1 / 5]
        out[0] *= beside[0]
        for k in range(1, n):
            beside.append(1 / ((5 if k == n - 1 else 4) - beside[-1]))
            out[k] = (out[k] - out[k - 1]) * beside[k]
        for k in range(n - 2, -1, -1):
            out[k] -= beside[k] * out[k + 1]
        return out.T

    for a in r.axes:
        r = along(r, a, solve)
    return r


#: Points that one kernel call interpolates; a tile with more of them is dealt to several calls.
TILE_POINTS = 1 << 17


def _interpolated(r: Raster, points: DataFrame, coordinates: Sequence[Column], interpolator: str) -> DataFrame:
    """``points`` with ``s``, the raster's value at physical coordinates, and ``found``: whether the
    point is inside and any voxel weighs in.  One shuffle deals voxels and points to tiles of
    voxels; voxels near a tile's border also go to the tiles behind it."""
    from .window import BLOCK_VOXELS

    if interpolator == "bspline":
        r = bspline_coefficients(r)
    nearest = interpolator == "nearest"
    radius, weight = (1, None) if nearest else KERNELS[interpolator]
    axes, size = r.axes, r.geometry.size
    side = max(2, round(BLOCK_VOXELS ** (1 / r.dim)))
    tiles, at, ci = ([f"{k}_{a}" for a in axes] for k in ("tile", "at", "ci"))
    tile = lambda c: F.floor(c / side).cast("int")

    index = index_columns(r.geometry, coordinates)
    near = [F.coalesce(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(n - 1.0)), F.lit(0.0)) for c, n in zip(ci, size)]  # NaN is greatest
    placed = points.select("*", *[c.cast("double").alias(n) for c, n in zip(index, ci)]).select("*", *[tile(F.floor(c)).alias(t) for c, t in zip(near, tiles)])
    crowded = placed.groupBy("image_id", *tiles).count().where(F.col("count") > TILE_POINTS)
    crowded = F.broadcast(crowded.select("image_id", *tiles, F.ceil(F.col("count") / TILE_POINTS).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    placed = placed.join(crowded, ["image_id", *tiles], "left").withColumn("part", F.pmod(F.xxhash64("point_id"), parts).cast("int")).drop("parts")

    voxels = r.df.where(reduce(lambda a, b: a & b, [F.col(a).between(0, n - 1) for a, n in zip(axes, size)]))
    voxels = voxels.select("image_id", *[F.col(a).cast("int").alias(i) for a, i in zip(axes, at)], F.col("v").cast("double").alias("s"))
    for i, t, n in zip(at, tiles, size):
        c = F.col(i)
        voxels = voxels.withColumn(t, F.explode(F.sequence(tile(F.greatest(c - radius, F.lit(0))), tile(F.least(c + radius, F.lit(n - 1))))))
    voxels = voxels.join(crowded, ["image_id", *tiles], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    both = placed.unionByName(voxels, allowMissingColumns=True)
    kept = [c for c in both.columns if c in points.columns]

    def run(rows: pa.Table) -> pa.Table:
        voxel = rows.column(at[0]).is_valid()
        own, there = rows.filter(pa.compute.invert(voxel)), rows.filter(voxel)
        n = own.num_rows
        low = [max(rows.column(t)[0].as_py() * side - radius, 0) for t in tiles]
        high = [min((rows.column(t)[0].as_py() + 1) * side + radius, k) for t, k in zip(tiles, size)]
        shape = [z - a for a, z in zip(low, high)]
        # 0: no voxel there, 1: a null one, 2: a value
        dense, state = np.zeros(shape), np.zeros(shape, np.int8)
        if there.num_rows:
            i = tuple(there.column(c).to_numpy() - k for c, k in zip(at, low))
            valid = there.column("s").is_valid().to_numpy()
            dense[i] = np.where(valid, there.column("s").to_numpy(), 0.0)
            state[i] = 1 + valid
        dense, state = dense.ravel(), state.ravel()
        step = [int(np.prod(shape[k + 1 :])) for k in range(len(shape))]
        c = [own.column(x).to_numpy().astype(float) for x in ci]
        with np.errstate(invalid="ignore"):
            inside = reduce(np.logical_and, [(x >= -0.5) & (x < k - 0.5) for x, k in zip(c, size)])
        c = [np.where(inside, x, lo) for x, lo in zip(c, low)]
        taps, weights = [], []
        for x, lo, k, by in zip(c, low, size, step):
            base = np.floor(x + 0.5 if nearest else x)
            reach = [0] if nearest else range(1 - radius, radius + 1)
            taps.append([(np.clip(base + j, 0, k - 1).astype(np.int64) - lo) * by for j in reach])
            weights.append([np.ones(n) if nearest else weight(x - base - j) for j in reach])
        total, share, seen, valued = np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
        for tap, each in zip(itertools.product(*taps), itertools.product(*weights)):
            place = reduce(lambda a, b: a + b, tap)
            w = reduce(lambda a, b: a * b, each)
            kind = np.where(w != 0, state[place], 0)
            seen |= kind > 0
            valued |= kind == 2
            share += np.where(kind > 0, w, 0.0)
            total += np.where(kind == 2, w, 0.0) * np.where(kind == 2, dense[place], 0.0)
        if interpolator == "gaussian":
            total = np.divide(total, share, out=np.zeros(n), where=share != 0)
        found = inside & seen
        columns = [own.column(c) for c in kept]
        return pa.Table.from_arrays([*columns, pa.array(total, mask=~(found & valued)), pa.array(found)], names=[*kept, "s", "found"])

    schema = ", ".join(f"`{c}` {t}" for c, t in both.dtypes if c in kept)
    return both.groupBy("image_id", *tiles, "part").applyInArrow(run, f"{schema}, s double, found boolean")


def sample(r: Raster, points: DataFrame, coordinates: Sequence[Column], interpolator: str = "linear") -> DataFrame:
    """``points`` with ``s``: the raster's value at physical coordinates; rows outside are dropped.

    ``points`` has image_id and a unique ``point_id``.
    """
    return _interpolated(r, points, coordinates, interpolator).where("found").drop("found")


def resample(r: Raster, geometry: Geometry | None = None, transform: Affine | None = None, interpolator: str = "linear", default: float = 0) -> Raster:
    """The raster on another grid: output points go through ``transform`` to the input."""
    g = geometry or r.geometry
    t = transform or identity(r.dim)
    out = Raster(grid(r.df, g), g, r.pixel, r.meta)
    points = out.df.withColumn("point_id", out.pos)
    return _at_points(r, out, points, t.columns(point_columns(g, out.axes)), interpolator, default)


def _at_points(r: Raster, out: Raster, points: DataFrame, coordinates: Sequence[Column], interpolator: str, default: float) -> Raster:
    """One voxel of ``out`` for each point, ``default`` where the raster has no value."""
    found = _interpolated(r, points, coordinates, interpolator)
    return Raster(found.select(*out.keys, r.pixel.saturate(F.coalesce("s", F.lit(float(default)))).alias("v")), out.geometry, r.pixel, out.meta)


def warp(r: Raster, field: Raster, interpolator: str = "linear", default: float = 0) -> Raster:
    """Resampling through a displacement field: vector pixels added to each output point."""
    g = field.geometry
    out = Raster(field.df, g, r.pixel)
    p = [f"p_{a}" for a in out.axes]
    points = field.df.select(*out.keys, out.pos.alias("point_id"), *[(c + F.col("v")[k]).alias(n) for k, (c, n) in enumerate(zip(point_columns(g, out.axes), p))])
    return _at_points(r, out, points, [F.col(n) for n in p], interpolator, default)


def displacement_field(like: Raster, transform: Affine) -> Raster:
    """The transform's displacement of each voxel's point, as a vector pixel."""
    p = point_columns(like.geometry, like.axes)
    return Raster(like.df.select(*like.keys, F.array(*[a - b for a, b in zip(transform.columns(p), p)]).alias("v")), like.geometry, PIXELS["float64"])


def jacobian_determinant(field: Raster) -> Raster:
    """Determinant of identity plus the gradient of a displacement field."""
    from . import fields

    return fields.jacobian_determinant(field)


def write_transform(t: Affine) -> str:
    """The legacy text form of an affine transform."""
    d = len(t.translation)
    text = lambda v: " ".join(repr(float(x)) for x in v)
    return f"#Insight Transform File V1.0\n#Transform 0\nTransform: AffineTransform_double_{d}_{d}\nParameters: {text([*(x for row in t.matrix for x in row), *t.translation])}\nFixedParameters: {text(t.centre or (0.0,) * d)}\n"


def read_transform(text: str) -> Affine:
    fields = dict(line.split(": ", 1) for line in text.splitlines() if ": " in line and not line.startswith("#"))
    centre = tuple(map(float, fields["FixedParameters"].split()))
    d, p = len(centre), list(map(float, fields["Parameters"].split()))
    if not fields["Transform"].startswith("AffineTransform"):
        raise ValueError("only affine transforms are read")
    return Affine(tuple(tuple(p[k * d : (k + 1) * d]) for k in range(d)), tuple(p[d * d :]), centre)
