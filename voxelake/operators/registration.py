"""Registration: metrics as aggregations, optimisers as driver loops over a few parameters.

Only the metric's value and gradient (one row) reach the driver in a round.  Exhaustive
search evaluates all its candidates in one job.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import Raster
from .resample import Affine, _cubic, euler_2d, point_columns, resample, sample, translation
from .window import gradient

TransformOf = Callable[[Sequence[float]], Affine]


def _pairs(fixed: Raster, moving: Raster, transform: Affine) -> DataFrame:
    """Fixed values ``f`` and moving values ``s`` at the fixed voxels whose points fall inside."""
    points = fixed.df.withColumnRenamed("v", "f").withColumn("point_id", fixed.pos)
    return sample(moving, points, transform.columns(point_columns(fixed.geometry, fixed.axes)))


def mean_squares(fixed: Raster, moving: Raster, transform: Affine) -> DataFrame:
    """value (mean squared difference over valid points) and points."""
    d = F.col("f").cast("double") - F.col("s")
    return _pairs(fixed, moving, transform).agg(F.avg(d * d).alias("value"), F.count(d).alias("points"))


def correlation(fixed: Raster, moving: Raster, transform: Affine) -> DataFrame:
    """Negative squared correlation."""
    c = F.corr(F.col("f").cast("double"), F.col("s"))
    return _pairs(fixed, moving, transform).agg((-c * c).alias("value"), F.count("f").alias("points"))


def mutual_information(fixed: Raster, moving: Raster, transform: Affine, bins: int = 32) -> DataFrame:
    """Negative mutual information of the joint histogram."""
    limits = lambda r: r.df.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
    (flo, fhi), (mlo, mhi) = limits(fixed), limits(moving)
    number = lambda c, lo, hi: F.least(F.floor((c - lo) / max(hi - lo, 1e-12) * bins), F.lit(bins - 1))
    joint = _pairs(fixed, moving, transform).groupBy(number(F.col("f").cast("double"), flo, fhi).alias("a"), number(F.col("s"), mlo, mhi).alias("b")).count()
    side = lambda c: joint.groupBy(c).agg(F.sum("count").alias(f"n_{c}"))
    n = joint.agg(F.sum("count").alias("n"))
    rows = joint.join(side("a"), "a").join(side("b"), "b").join(F.broadcast(n))  # one row
    p = F.col("count") / F.col("n")
    return rows.agg((-F.sum(p * F.log(F.col("count") * F.col("n") / (F.col("n_a") * F.col("n_b"))))).alias("value"), F.max("n").alias("points"))


def mattes(fixed: Raster, moving: Raster, transform: Affine, bins: int = 50) -> DataFrame:
    """Negative mutual information of a smooth joint histogram: a pair counts in one bin of the fixed
    value and, by a cubic spline, in four of the moving value; two bins at each end are spare."""
    limits = lambda r: r.df.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
    (flo, fhi), (mlo, mhi) = limits(fixed), limits(moving)
    place = lambda c, lo, hi: (c - lo) / (max(hi - lo, 1e-12) / (bins - 4)) + 2
    held = lambda c: F.greatest(F.least(F.floor(c), F.lit(bins - 3)), F.lit(2))
    near = _pairs(fixed, moving, transform).select(held(place(F.col("f").cast("double"), flo, fhi)).alias("a"), place(F.col("s"), mlo, mhi).alias("at"))
    near = near.withColumn("b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1, 2))), lambda k: k + held(F.col("at")))))
    joint = near.groupBy("a", "b").agg(F.sum(_cubic(F.col("at") - F.col("b"))).alias("w"), F.count(F.lit(1)).alias("c"))  # at most bins * bins rows
    side = lambda c: joint.groupBy(c).agg(F.sum("w").alias(f"w_{c}"))
    rows = joint.join(side("a"), "a").join(side("b"), "b").join(F.broadcast(joint.agg(F.sum("w").alias("n"))))  # one row
    p = F.col("w") / F.col("n")
    term = F.when(F.col("w") > 0, p * F.log(F.col("w") * F.col("n") / (F.col("w_a") * F.col("w_b")))).otherwise(0.0)
    return rows.agg((-F.sum(term)).alias("value"), (F.sum("c") / 4).cast("long").alias("points"))


def neighborhood_correlation(fixed: Raster, moving: Raster, transform: Affine, radius: Sequence[int]) -> DataFrame:
    """Negative mean, over valid points, of the squared correlation within boxes (1 in a flat box).

    The box sums are running frames along each axis, over all six moments at once.
    """
    found = _pairs(fixed, moving, transform).select(*fixed.keys, "s")
    f, s = F.col("v").cast("double"), F.col("s")
    moments = {"n": F.lit(1.0), "f": f, "m": s, "ff": f * f, "mm": s * s, "fm": f * s}
    rows = fixed.df.join(found, fixed.keys, "left").select(*fixed.keys, s.isNotNull().alias("valid"), *[F.when(s.isNotNull(), c).otherwise(0.0).alias(k) for k, c in moments.items()])
    for a, k in zip(fixed.axes, radius):
        box = fixed.line(a).rowsBetween(-k, k)
        rows = rows.select(*fixed.keys, "valid", *[F.sum(c).over(box).alias(c) for c in moments])
    n = F.col("n")
    part = lambda both, x, y: F.col(both) - F.col(x) * F.col(y) / n
    spread = part("ff", "f", "f") * part("mm", "m", "m")
    local = F.when(F.abs(spread) > 2**-52, F.pow(part("fm", "f", "m"), 2) / F.nullif(spread, F.lit(0.0))).otherwise(1.0)
    return rows.where("valid").agg((-F.avg(local)).alias("value"), F.count(F.lit(1)).alias("points"))


METRICS = {"mean_squares": mean_squares, "correlation": correlation, "mutual_information": mutual_information, "mattes": mattes}


def exhaustive(fixed: Raster, moving: Raster, transform_of: TransformOf, grid: Sequence[Sequence[float]], metric: str = "mean_squares") -> tuple[tuple[float, ...], float]:
    """The best of all parameter combinations, evaluated in one job."""
    parts = None
    for values in itertools.product(*grid):
        row = METRICS[metric](fixed, moving, transform_of(values)).select("value", F.array(*[F.lit(float(v)) for v in values]).alias("p"))
        parts = row if parts is None else parts.unionByName(row)
    best = parts.where("value is not null").orderBy("value", "p").first()
    return tuple(best.p), best.value


def _slope(fixed: Raster, moving: Raster, slopes: Raster, transform: Affine) -> tuple[float, list[float]]:
    """Mean squares and its derivative by translation."""
    pairs = _pairs(fixed, moving, transform)
    out = []
    for k in range(fixed.dim):
        component = Raster(slopes.df.withColumn("v", F.col("v")[k]), slopes.geometry, slopes.pixel)
        g = sample(component, fixed.df.select(*fixed.keys, fixed.pos.alias("point_id")), transform.columns(point_columns(fixed.geometry, fixed.axes))).select("image_id", "point_id", F.col("s").alias(f"g{k}"))
        pairs = pairs.join(g, ["image_id", "point_id"])
        out.append(F.avg(2 * (F.col("s") - F.col("f")) * F.col(f"g{k}")).alias(f"d{k}"))
    d = F.col("f").cast("double") - F.col("s")
    row = pairs.agg(F.avg(d * d).alias("value"), *out).first()
    return row.value, [row[f"d{k}"] for k in range(fixed.dim)]


def register_translation(fixed: Raster, moving: Raster, step: float = 1.0, shortest: float = 0.05, rounds: int = 30) -> tuple[tuple[float, ...], float]:
    """Regular-step gradient descent on mean squares: the step halves when the gradient turns."""
    moving = Raster(moving.df.withColumn("v", F.col("v").cast("double")), moving.geometry, moving.pixel)
    slopes = gradient(moving)
    at, before, value = [0.0] * fixed.dim, None, math.inf
    for _ in range(rounds):
        value, g = _slope(fixed, moving, slopes, translation(at))
        norm = math.sqrt(sum(x * x for x in g))
        if norm < 1e-12:
            break
        if before and sum(a * b for a, b in zip(g, before)) < 0:
            step /= 2
        if step < shortest:
            break
        at, before = [a - step * x / norm for a, x in zip(at, g)], g
    return tuple(at), value


def centred_initializer(fixed: Raster, moving: Raster) -> Affine:
    """Translation between the intensity-weighted centres."""
    centres = []
    for r in (fixed, moving):
        p = point_columns(r.geometry, r.axes)
        row = r.df.agg(*[(F.sum(c * F.col("v")) / F.sum("v")).alias(a) for c, a in zip(p, r.axes)]).first()
        centres.append([row[a] for a in r.axes])
    return translation([m - f for f, m in zip(*centres)])


def pyramid(fixed: Raster, moving: Raster, factors: Sequence[int] = (4, 2, 1)) -> tuple[tuple[float, ...], float]:
    """Translation registration from coarse to fine grids."""
    from .geometry import bin_shrink

    at, value = (0.0,) * fixed.dim, math.inf
    for f in factors:
        small = [bin_shrink(Raster(r.df, r.geometry, r.pixel), [f] * r.dim) for r in (fixed, moving)]
        start = resample(small[1], small[0].geometry, translation(at)) if any(at) else small[1]
        found, value = register_translation(small[0], start, step=float(f))
        at = tuple(a + b for a, b in zip(at, found))
    return at, value


def register_rotation(fixed: Raster, moving: Raster, angles: Sequence[float], centre: Sequence[float]) -> tuple[float, float]:
    """The best rotation about a centre among stated angles."""
    found, value = exhaustive(fixed, moving, lambda p: euler_2d(p[0], centre=centre), [angles])
    return found[0], value
