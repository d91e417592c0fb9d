"""Noise from a hash of seed and voxel: the same whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..raster import Raster


def uniform(r: Raster, seed: int, stream: int = 0) -> Column:
    """A number in (0, 1) for each voxel."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), F.col("image_id"), r.pos), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def normal(r: Raster, seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(r, seed, 1))) * F.cos(2 * math.pi * uniform(r, seed, 2))


def additive_gaussian_noise(r: Raster, sigma: float = 1, mean: float = 0, seed: int = 0) -> Raster:
    return r.map(lambda v: v.cast("double") + mean + sigma * normal(r, seed))


def salt_and_pepper_noise(r: Raster, probability: float = 0.01, seed: int = 0) -> Raster:
    """The type's extremes (for reals: +-1) with half the probability each."""
    low, high = (float(r.pixel.low), float(r.pixel.high)) if r.pixel.integer else (-1.0, 1.0)
    u = uniform(r, seed)
    return r.map(lambda v: F.when(u < probability / 2, low).when(u < probability, high).otherwise(v.cast("double")))


def speckle_noise(r: Raster, sigma: float = 1, seed: int = 0) -> Raster:
    """Value times a positive variable of mean 1 and variance sigma^2 (log-normal)."""
    s = math.log(1 + sigma * sigma)
    return r.map(lambda v: v.cast("double") * F.exp(math.sqrt(s) * normal(r, seed) - s / 2))


def shot_noise(r: Raster, scale: float = 1, seed: int = 0) -> Raster:
    """Poisson(v * scale) / scale by its normal approximation."""
    return r.map(lambda v: F.greatest(F.floor(v.cast("double") * scale + F.sqrt(F.greatest(v.cast("double") * scale, F.lit(0.0))) * normal(r, seed) + 0.5), F.lit(0)) / scale)
