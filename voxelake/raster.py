"""Rasters as DataFrames: one row for each voxel, geometry on the driver.

A raster's DataFrame has ``image_id`` (many images of one grid may share a DataFrame), one
integer column for each axis (``x``, ``y``, ``z``: the first varies fastest in raster
order), and the value ``v``.  Operators are lazy: they return a new raster whose plan
Catalyst optimises as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

AXES = ("x", "y", "z", "t")


@dataclass(frozen=True)
class Pixel:
    """A scalar pixel type: its Spark type and, for integers, its range."""

    name: str
    spark: str
    low: int | None = None
    high: int | None = None

    @property
    def integer(self) -> bool:
        return self.low is not None

    def saturate(self, value: Column) -> Column:
        """A double narrowed to this type: truncated and held in range, NaN as 0 for integers."""
        if not self.integer:
            return value.cast(self.spark)
        wide = value.cast("double")
        low, high = F.lit(self.low).cast(self.spark), F.lit(self.high).cast(self.spark)
        whole = F.when(wide >= 0, F.floor(wide)).otherwise(F.ceil(wide))
        return F.when(F.isnan(wide), F.lit(0).cast(self.spark)).when(wide <= float(self.low), low).when(wide >= float(self.high), high).otherwise(whole.cast(self.spark))

    def wrap(self, value: Column) -> Column:
        """An exact integer (long or decimal) wrapped around this type's range."""
        if not self.integer:
            return value.cast(self.spark)
        span = F.lit(self.high - self.low + 1).cast("decimal(38,0)" if self.high > 2**31 else "long")
        return (F.pmod(value - F.lit(self.low), span) + F.lit(self.low)).cast(self.spark)

    @property
    def exact(self) -> str:
        """The Spark type in which sums and products of two values are exact."""
        return "double" if not self.integer else "decimal(38,0)" if self.high > 2**31 else "long"


PIXELS = {
    p.name: p
    for p in (
        Pixel("uint8", "smallint", 0, 255), Pixel("int8", "smallint", -128, 127),
        Pixel("uint16", "int", 0, 2**16 - 1), Pixel("int16", "smallint", -(2**15), 2**15 - 1),
        Pixel("uint32", "bigint", 0, 2**32 - 1), Pixel("int32", "int", -(2**31), 2**31 - 1),
        Pixel("uint64", "decimal(20,0)", 0, 2**64 - 1), Pixel("int64", "bigint", -(2**63), 2**63 - 1),
        Pixel("float32", "float"), Pixel("float64", "double"),
    )
}


@dataclass(frozen=True)
class Geometry:
    """Size and physical placement of a grid."""

    size: tuple[int, ...]
    spacing: tuple[float, ...] = ()
    origin: tuple[float, ...] = ()
    direction: tuple[tuple[float, ...], ...] = ()

    def __post_init__(self):
        d = len(self.size)
        object.__setattr__(self, "spacing", tuple(self.spacing) or (1.0,) * d)
        object.__setattr__(self, "origin", tuple(self.origin) or (0.0,) * d)
        object.__setattr__(self, "direction", tuple(map(tuple, self.direction)) or tuple(map(tuple, np.eye(d).tolist())))

    @property
    def count(self) -> int:
        return int(np.prod(self.size))

    def to_point(self, index: Sequence[float]) -> tuple[float, ...]:
        """Physical point of a (continuous) index."""
        return tuple((np.array(self.origin) + np.array(self.direction) @ (np.array(self.spacing) * np.array(index))).tolist())

    def to_index(self, point: Sequence[float]) -> tuple[float, ...]:
        """Continuous index of a physical point."""
        return tuple((np.linalg.inv(np.array(self.direction)) @ (np.array(point) - np.array(self.origin)) / np.array(self.spacing)).tolist())

    def shifted(self, start: Sequence[float], size: Sequence[int], step: Sequence[int] | None = None) -> Geometry:
        """The grid that starts at index ``start`` of this one, with every ``step``-th voxel."""
        step = step or (1,) * len(self.size)
        return replace(self, size=tuple(size), origin=self.to_point(start), spacing=tuple(s * abs(k) for s, k in zip(self.spacing, step)))

    def congruent(self, other: Geometry, tolerance: float = 1e-6) -> bool:
        near = lambda a, b: np.allclose(np.array(a), np.array(b), rtol=0, atol=tolerance)
        return self.size == other.size and near(self.origin, other.origin) and near(self.spacing, other.spacing) and near(self.direction, other.direction)


@dataclass(frozen=True)
class Raster:
    df: DataFrame
    geometry: Geometry
    pixel: Pixel
    meta: dict[str, str] = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return len(self.geometry.size)

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: self.dim]

    @property
    def keys(self) -> list[str]:
        return ["image_id", *self.axes]

    def size(self, axis: str) -> int:
        return self.geometry.size[AXES.index(axis)]

    @property
    def pos(self) -> Column:
        """Raster position: x + nx * (y + ny * z)."""
        return reduce(lambda p, a: p * self.size(a) + F.col(a), reversed(self.axes), F.lit(0).cast("long"))

    def line(self, axis: str) -> WindowSpec:
        """The voxels of one line along ``axis``, in order."""
        return Window.partitionBy("image_id", *[a for a in self.axes if a != axis]).orderBy(axis)

    def map(self, value: Callable[[Column], Column] | Column, pixel: Pixel | str | None = None) -> Raster:
        """A new value for each voxel, narrowed to ``pixel`` (default: this raster's type)."""
        pixel = PIXELS[pixel] if isinstance(pixel, str) else pixel or self.pixel
        column = value(F.col("v")) if callable(value) else value
        return Raster(self.df.select(*self.keys, pixel.saturate(column).alias("v")), self.geometry, pixel, self.meta)

    def with_rows(self, df: DataFrame, geometry: Geometry | None = None, pixel: Pixel | str | None = None) -> Raster:
        """Another raster from rows that have its keys and ``v``."""
        geometry = geometry or self.geometry
        pixel = PIXELS[pixel] if isinstance(pixel, str) else pixel or self.pixel
        return Raster(df.select("image_id", *AXES[: len(geometry.size)], F.col("v").cast(pixel.spark).alias("v")), geometry, pixel, self.meta)

    def zip(self, *others: Raster) -> DataFrame:
        """Rows of congruent rasters joined by voxel: values ``v0``, ``v1``, ..."""
        out = self.df.withColumnRenamed("v", "v0")
        for k, o in enumerate(others, 1):
            if not self.geometry.congruent(o.geometry):
                raise ValueError("rasters do not lie on the same grid")
            out = out.join(o.df.withColumnRenamed("v", f"v{k}"), self.keys)
        return out

    # Operators on rasters wrap around in the pixel type; constants are cast to it first.
    def _operate(self, other: Raster | float, op: Callable[[Column, Column], Column]) -> Raster:
        exact = self.pixel.exact
        if isinstance(other, Raster):
            rows, right = self.zip(other), F.col("v1")
        else:
            rows, right = self.df.withColumnRenamed("v", "v0"), self.pixel.saturate(F.lit(float(other)))
        return self.with_rows(rows.withColumn("v", self.pixel.wrap(op(F.col("v0").cast(exact), right.cast(exact)))))

    def __add__(self, other):
        return self._operate(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._operate(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._operate(other, lambda a, b: a * b)

    def __neg__(self):
        return self._operate(0, lambda a, b: b - a)


def grid(like: DataFrame, geometry: Geometry) -> DataFrame:
    """All voxels of ``geometry`` for every image of ``like``: its keys only."""
    images = like.select("image_id").distinct()
    out = images
    for a, n in zip(AXES, geometry.size):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def from_table(rows: DataFrame, geometry: Geometry, pixel: str = "float64", fill: float | None = None) -> Raster:
    """A raster from rows with image_id, axes and v; missing voxels become ``fill`` if given."""
    p = PIXELS[pixel]
    axes = AXES[: len(geometry.size)]
    rows = rows.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(a).cast("int").alias(a) for a in axes], F.col("v").cast(p.spark).alias("v"))
    if fill is not None:
        rows = grid(rows, geometry).join(rows, ["image_id", *axes], "left").withColumn("v", F.coalesce("v", F.lit(fill).cast(p.spark)))
    return Raster(rows, geometry, p)
