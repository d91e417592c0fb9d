"""Spatial transforms with parameters, evaluated on arrays of points inside tasks.

A transform gives the images of points and, for vectors at the points, sums from which the
gradient over all its parameters follows.  Tasks return those sums (``moments``), which add
up over tasks; ``gradient`` turns the total into the gradient.  A matrix transform has
d*d + d of them, whatever its parameters mean; a B-spline has one for each control value,
and a point touches only the 4^d controls around it.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..raster import PIXELS, Geometry, Raster
from .resample import Affine, index_columns, point_columns

#: Control values that a lattice may hold, as the driver and every task hold them.
MOST_CONTROLS = 1 << 22


def _rotation_2d(angle):
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, -s], [s, c]])


def _rotation_3d(x, y, z):
    """Rotations about the axes, combined as Rz Rx Ry."""
    one, none = np.ones_like(x), np.zeros_like(x)
    (cx, sx), (cy, sy), (cz, sz) = ((np.cos(a), np.sin(a)) for a in (x, y, z))
    rx = np.array([[one, none, none], [none, cx, -sx], [none, sx, cx]])
    ry = np.array([[cy, none, sy], [none, one, none], [-sy, none, cy]])
    rz = np.array([[cz, -sz, none], [sz, cz, none], [none, none, one]])
    return rz @ rx @ ry


def _versor(x, y, z):
    """Rotation by the unit quaternion with this vector part."""
    w = np.sqrt(1 - x * x - y * y - z * z)
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


#: For each kind: its identity's parameters, and matrix and translation of given ones.
KINDS = {
    "translation": (lambda d: [0.0] * d, lambda p, d: (np.eye(d), p)),
    "scale": (lambda d: [1.0] * d, lambda p, d: (np.diag(p), np.zeros(d))),
    "scale_logarithmic": (lambda d: [0.0] * d, lambda p, d: (np.diag(np.exp(p)), np.zeros(d))),
    "affine": (lambda d: [*np.eye(d).ravel(), *[0.0] * d], lambda p, d: (p[: d * d].reshape(d, d), p[d * d :])),
    "euler_2d": (lambda d: [0.0] * 3, lambda p, d: (_rotation_2d(p[0]), p[1:])),
    "similarity_2d": (lambda d: [1.0, 0.0, 0.0, 0.0], lambda p, d: (p[0] * _rotation_2d(p[1]), p[2:])),
    "euler_3d": (lambda d: [0.0] * 6, lambda p, d: (_rotation_3d(*p[:3]), p[3:])),
    "versor_rigid_3d": (lambda d: [0.0] * 6, lambda p, d: (_versor(*p[:3]), p[3:])),
    "similarity_3d": (lambda d: [0.0] * 6 + [1.0], lambda p, d: (p[6] * _versor(*p[:3]), p[3:6])),
    "scale_versor_3d": (lambda d: [0.0] * 6 + [1.0] * 3, lambda p, d: (_versor(*p[:3]) + np.diag(p[6:] - 1), p[3:6])),
}


@dataclass(frozen=True)
class MatrixTransform:
    """x -> A (x - centre) + centre + t, where A and t follow from the parameters."""

    kind: str
    dim: int
    parameters: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()

    def __post_init__(self):
        start = KINDS[self.kind][0](self.dim)
        object.__setattr__(self, "parameters", tuple(map(float, self.parameters or start)))
        object.__setattr__(self, "centre", tuple(map(float, self.centre or (0.0,) * self.dim)))
        if len(self.parameters) != len(start):
            raise ValueError(f"{self.kind} takes {len(start)} parameters")

    def with_parameters(self, p: Sequence[float]) -> MatrixTransform:
        return replace(self, parameters=tuple(p))

    def parts(self, p=None) -> tuple[np.ndarray, np.ndarray]:
        return KINDS[self.kind][1](np.array(self.parameters if p is None else p), self.dim)

    def affine(self) -> Affine:
        """The same as column expressions."""
        matrix, shift = self.parts()
        return Affine(tuple(map(tuple, matrix.tolist())), tuple(np.asarray(shift).tolist()), self.centre)

    def points(self, p: np.ndarray) -> np.ndarray:
        matrix, shift = self.parts()
        return (p - self.centre) @ matrix.T + self.centre + shift

    def moments(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Sums over points of ``g`` (points, axes, columns) with the places they stand at."""
        d, k = self.dim, g.shape[2]
        return np.concatenate((np.einsum("nrk,nc->rck", g, p - self.centre).reshape(d * d, k), g.sum(0)))

    def gradient(self, moments: np.ndarray) -> np.ndarray:
        """The gradient over the parameters; derivatives of A and t by complex steps."""
        d, out = self.dim, []
        for j in range(len(self.parameters)):
            p = np.array(self.parameters, complex)
            p[j] += 1e-30j
            matrix, shift = self.parts(p)
            slope = np.concatenate((np.imag(matrix).ravel(), np.imag(shift))) / 1e-30
            out.append(slope @ moments[: d * d + d])
        return np.array(out)

    def pulled(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Vectors at the images of points, as vectors at the points."""
        return np.einsum("rc,nrk->nck", self.parts()[0], g)

    def inverse(self) -> MatrixTransform:
        """As an affine transform."""
        back = self.affine().inverse()
        return MatrixTransform("affine", self.dim, (*np.ravel(back.matrix), *back.translation))


def cubic(x: np.ndarray) -> np.ndarray:
    """The cubic B-spline."""
    a = np.abs(x)
    return np.where(a < 1, 2 / 3 - a * a + a**3 / 2, np.maximum(2 - a, 0) ** 3 / 6)


def cubic_slope(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    return np.sign(x) * np.where(a < 1, 1.5 * a * a - 2 * a, -0.5 * np.maximum(2 - a, 0) ** 2)


@dataclass(frozen=True)
class BSplineTransform:
    """x -> x + displacement, a cubic B-spline of a lattice of control vectors.

    Points outside the lattice's inner region stay.  ``parameters`` are the controls of the first
    axis, then of the next; within an axis the first axis of the lattice varies fastest.
    """

    lattice: Geometry
    parameters: np.ndarray

    @staticmethod
    def over(origin: Sequence[float], extent: Sequence[float], direction: Sequence[Sequence[float]], mesh: Sequence[int]) -> BSplineTransform:
        """Zero displacements over a box of ``mesh`` cells."""
        if min(mesh) < 1:
            raise ValueError("the mesh needs a cell or more on each axis")
        spacing = np.array(extent) / mesh
        size = tuple(m + 3 for m in mesh)
        first = np.array(origin) - np.array(direction) @ spacing
        n = len(size) * int(np.prod(size))
        if n > MOST_CONTROLS:
            raise ValueError(f"a lattice holds at most {MOST_CONTROLS} control values")
        return BSplineTransform(Geometry(size, tuple(spacing.tolist()), tuple(first.tolist()), tuple(map(tuple, direction))), np.zeros(n))

    @staticmethod
    def around(g: Geometry, mesh: Sequence[int], margin: float = 0.125) -> BSplineTransform:
        """Over a grid's voxels and ``margin`` voxels beyond, its axes in the order of the space's
        and pointing up them as far as they can."""
        d = len(g.size)
        corners = {o: np.array(g.to_point([(n - 0.5 + margin) if k else -0.5 - margin for k, n in zip(o, g.size)])) for o in itertools.product((0, 1), repeat=d)}
        low = np.min(list(corners.values()), axis=0)
        start = min(corners, key=lambda o: (((corners[o] - low) ** 2).sum(), o[::-1]))
        edges = {k: corners[tuple(b ^ (i == k) for i, b in enumerate(start))] - corners[start] for k in range(d)}
        extent, columns = [], []
        for axis in range(d):
            k = max(edges, key=lambda k: (edges[k][axis] / np.linalg.norm(edges[k]), -k))
            edge = edges.pop(k)
            extent.append(float(np.linalg.norm(edge)))
            columns.append(edge / extent[-1])
        return BSplineTransform.over(corners[start], extent, np.array(columns).T.tolist(), mesh)

    @property
    def dim(self) -> int:
        return len(self.lattice.size)

    @property
    def controls(self) -> np.ndarray:
        """Control vectors: axis, then number of the control."""
        return np.reshape(self.parameters, (self.dim, -1))

    def with_parameters(self, p: Sequence[float]) -> BSplineTransform:
        if len(p) != len(self.parameters):
            raise ValueError(f"this lattice takes {len(self.parameters)} parameters")
        return replace(self, parameters=np.array(p, float))

    def _index(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Continuous lattice index of points, and which are inside."""
        g = self.lattice
        index = (p - g.origin) @ np.linalg.inv(np.array(g.direction) * g.spacing).T
        high = np.array(g.size) - 2.0
        edge = np.abs(index - high) <= 1e-15 * np.maximum(high, 1)
        index = np.where(edge, np.nextafter(high, 0), index)
        return index, ((index >= 1) & (index < high)).all(1)

    def _support(self, index: np.ndarray, slope: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the 4^d controls of each place; with ``slope`` the weights'
        derivative along that axis of the lattice."""
        first = np.floor(index).astype(np.int64) - 1
        flat, weight = np.zeros((len(index), 1), np.int64), np.ones((len(index), 1))
        stride = 1
        for k, n in enumerate(self.lattice.size):
            at = first[:, k, None] + np.arange(4)
            w = (cubic_slope if k == slope else cubic)(index[:, k, None] - at)
            flat = (flat[:, None, :] + (at * stride)[:, :, None]).reshape(len(index), 4 ** (k + 1))
            weight = (weight[:, None, :] * w[:, :, None]).reshape(len(index), 4 ** (k + 1))
            stride *= n
        return flat, weight

    def points(self, p: np.ndarray) -> np.ndarray:
        index, inside = self._index(p)
        flat, weight = self._support(index[inside])
        out = np.array(p, float)
        out[inside] += np.einsum("ns,dns->nd", weight, self.controls[:, flat])
        return out

    def moments(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        index, inside = self._index(p)
        flat, weight = self._support(index[inside])
        n = self.controls.shape[1]
        sums = [[np.bincount(flat.ravel(), (weight * g[inside, r, k, None]).ravel(), n) for k in range(g.shape[2])] for r in range(self.dim)]
        return np.concatenate([np.stack(s, 1) for s in sums])

    def gradient(self, moments: np.ndarray) -> np.ndarray:
        return moments

    def pulled(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        index, inside = self._index(p)
        back = np.linalg.inv(np.array(self.lattice.direction) * self.lattice.spacing)
        out = np.array(g, float)
        for k in range(self.dim):
            flat, weight = self._support(index[inside], k)
            slope = np.einsum("ns,dns->nd", weight, self.controls[:, flat])
            out[inside] += np.einsum("nd,ndk->nk", slope, g[inside])[:, None, :] * back[k][:, None]
        return out

    def inverse_points(self, q: np.ndarray, rounds: int = 100, tolerance: float = 1e-10) -> np.ndarray:
        """Points that the transform maps to ``q``, by fixed-point steps (for displacements that
        shrink distances)."""
        p = np.array(q, float)
        for _ in range(rounds):
            step = q - self.points(p)
            p += step
            if np.abs(step).max(initial=0) < tolerance:
                break
        return p

    def table(self, spark: SparkSession) -> Raster:
        """The lattice as a raster of control vectors."""
        size = self.lattice.size
        rows = [(0, *map(int, np.unravel_index(i, size, order="F")), self.controls[:, i].tolist()) for i in range(self.controls.shape[1])]
        df = spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{a} int" for a in "xyzt"[: self.dim]) + ", v array<double>")
        return Raster(df, self.lattice, PIXELS["float64"])


@dataclass(frozen=True)
class Composite:
    """Transforms of a stack: the last of them is applied first."""

    stack: tuple

    @property
    def dim(self) -> int:
        return self.stack[0].dim

    @property
    def parameters(self) -> np.ndarray:
        return np.concatenate([np.asarray(t.parameters, float) for t in self.stack])

    def with_parameters(self, p: Sequence[float]) -> Composite:
        cuts = np.cumsum([len(t.parameters) for t in self.stack])[:-1]
        return Composite(tuple(t.with_parameters(x) for t, x in zip(self.stack, np.split(np.array(p, float), cuts))))

    def points(self, p: np.ndarray) -> np.ndarray:
        for t in reversed(self.stack):
            p = t.points(p)
        return p

    def _inputs(self, p: np.ndarray) -> list[np.ndarray]:
        """What each transform of the stack is applied to."""
        inputs = [p]
        for t in reversed(self.stack[1:]):
            inputs.append(t.points(inputs[-1]))
        return inputs[::-1]

    def moments(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = []
        for t, at in zip(self.stack, self._inputs(p)):
            out.append(t.moments(at, g))
            g = t.pulled(at, g)
        return np.concatenate(out)

    def pulled(self, p: np.ndarray, g: np.ndarray) -> np.ndarray:
        for t, at in zip(self.stack, self._inputs(p)):
            g = t.pulled(at, g)
        return g

    def gradient(self, moments: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for t in self.stack:
            n = len(t.parameters) if isinstance(t, BSplineTransform) else t.dim * (t.dim + 1)
            out.append(t.gradient(moments[at : at + n]))
            at += n
        return np.concatenate(out)


def displaced(r: Raster, lattice: Raster) -> DataFrame:
    """Keys and ``d``, the displacement of each voxel's point by a lattice of control vectors that
    is a table: every point joins the 4^d controls of its cell.  Outside the lattice it is 0."""
    g, dim = lattice.geometry, r.dim
    names = [f"c_{a}" for a in r.axes]
    rows = r.df.select(*r.keys, *[c.alias(n) for c, n in zip(index_columns(g, point_columns(r.geometry, r.axes)), names)])
    inside = F.lit(True)
    for n, size in zip(names, g.size):
        inside = inside & (F.col(n) >= 1) & (F.col(n) <= (size - 2) * (1 + 1e-15))
    corner = F.explode(F.array(*[F.array(*map(F.lit, c)) for c in itertools.product(range(-1, 3), repeat=dim)]))
    near = rows.where(inside).withColumn("corner", corner)
    weight, places = F.lit(1.0), []
    for k, (n, a) in enumerate(zip(names, r.axes)):
        place = F.least(F.floor(n), F.lit(g.size[k] - 3)) + F.col("corner")[k]
        x = F.abs(F.col(n) - place)
        weight = weight * F.when(x < 1, 2 / 3 - x * x + x * x * x / 2).otherwise((2 - x) * (2 - x) * (2 - x) / 6)
        places.append(place.cast("int").alias(f"i_{a}"))
    near = near.select(*r.keys, weight.alias("w"), *places)
    controls = lattice.df.select(*[F.col(a).alias(f"i_{a}") for a in r.axes], F.col("v").alias("control"))
    sums = near.join(controls, [f"i_{a}" for a in r.axes]).groupBy(*r.keys).agg(*[F.sum(F.col("w") * F.col("control")[k]).alias(f"d{k}") for k in range(dim)])
    return r.df.select(*r.keys).join(sums, r.keys, "left").select(*r.keys, F.array(*[F.coalesce(f"d{k}", F.lit(0.0)) for k in range(dim)]).alias("d"))
