"""Synthetic rasters: each voxel's value is an expression of its physical point."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..raster import PIXELS, Geometry, Raster, grid


def _points(r_axes: Sequence[str], g: Geometry) -> list[Column]:
    return [reduce(lambda s, j: s + F.col(r_axes[j]) * (g.direction[i][j] * g.spacing[j]), range(len(r_axes)), F.lit(g.origin[i])) for i in range(len(r_axes))]


def generate(spark: SparkSession, geometry: Geometry, value: Callable[[list[Column]], Column], pixel: str = "float64") -> Raster:
    """A raster from an expression of the physical coordinates."""
    p = PIXELS[pixel]
    keys = grid(spark.range(1).select(F.col("id").alias("image_id")), geometry)
    axes = keys.columns[1:]
    return Raster(keys.select("image_id", *axes, p.saturate(value(_points(axes, geometry))).alias("v")), geometry, p)


def constant_image(spark: SparkSession, geometry: Geometry, value: float = 0, pixel: str = "float64") -> Raster:
    return generate(spark, geometry, lambda _: F.lit(float(value)), pixel)


def gaussian_source(spark: SparkSession, geometry: Geometry, sigma: Sequence[float], mean: Sequence[float], scale: float = 255, normalized: bool = False) -> Raster:
    factor = 1 / math.prod(s * math.sqrt(2 * math.pi) for s in sigma) if normalized else 1.0
    return generate(spark, geometry, lambda p: F.lit(scale * factor) * F.exp(-sum(((c - m) * (c - m) / (2 * s * s) for c, m, s in zip(p, mean, sigma)), F.lit(0.0))))


def gabor_source(spark: SparkSession, geometry: Geometry, sigma: Sequence[float], mean: Sequence[float], frequency: float = 0.4) -> Raster:
    def value(p: list[Column]) -> Column:
        bell = F.exp(-sum(((c - m) * (c - m) / (2 * s * s) for c, m, s in zip(p, mean, sigma)), F.lit(0.0)))
        return bell * F.cos(2 * math.pi * frequency * (p[0] - mean[0]))

    return generate(spark, geometry, value)


def grid_source(spark: SparkSession, geometry: Geometry, sigma: Sequence[float], spacing: Sequence[float], offset: Sequence[float], scale: float = 255) -> Raster:
    """Dark lines at regular distances along each axis, as a product of inverted pulses."""

    def value(p: list[Column]) -> Column:
        parts = []
        for c, s, d, o in zip(p, sigma, spacing, offset):
            away = c - o - F.round((c - o) / d) * d
            parts.append(1 - F.exp(-away * away / (2 * s * s)))
        return F.lit(float(scale)) * reduce(lambda a, b: a * b, parts)

    return generate(spark, geometry, value)


def physical_point_source(spark: SparkSession, geometry: Geometry) -> Raster:
    """The physical coordinates of each voxel as a vector pixel."""
    keys = grid(spark.range(1).select(F.col("id").alias("image_id")), geometry)
    axes = keys.columns[1:]
    return Raster(keys.select("image_id", *axes, F.array(*_points(axes, geometry)).alias("v")), geometry, PIXELS["float64"])


def xorshift_volume(spark: SparkSession, size: Sequence[int], seed: int = 42, modulus: int = 1000, pixel: str = "float32") -> Raster:
    """The sequential pseudo-random volume of the published benchmark (xorshift64*, a fixed rule of
    shifts 12, 25, 27 and a multiplier), made on the driver: for small test volumes only."""
    state, values = seed, []
    for _ in range(math.prod(size)):
        state ^= state >> 12
        state ^= (state << 25) & (2**64 - 1)
        state ^= state >> 27
        values.append((state * 0x2545F4914F6CDD1D % 2**64 >> 33) % modulus)
    g = Geometry(tuple(size))
    rows = spark.createDataFrame([(0, values)], "image_id long, v array<long>").select("image_id", F.posexplode("v").alias("pos", "v"))
    at, out = F.col("pos"), []
    for n, a in zip(size, ("x", "y", "z")):
        out.append((at % n).cast("int").alias(a))
        at = F.floor(at / n)
    return Raster(rows.select("image_id", *out, F.col("v").cast(PIXELS[pixel].spark).alias("v")), g, PIXELS[pixel])
