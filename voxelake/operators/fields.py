"""Displacement fields: composition, and inversion by fixed-point rounds.

A field is a raster of vectors.  What a round needs of the forward field is read from a table of
cells: the vectors at the corners of each cell as one array, built once, which every point
joins by the cell it falls into.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..raster import Raster
from ..staging import staged
from .resample import index_columns, point_columns


def cells(u: Raster) -> DataFrame:
    """image_id, the cell's first voxel ``i_x``, ... (-1 before the first) and the vectors at its 2^d
    corners, the first axis fastest; the edge repeats beyond the grid."""
    rows = u.df.select(*u.keys, "v")
    for a in u.axes:
        n = u.size(a)
        ends = F.array(F.struct((F.col(a) - 1).cast("int").alias("cell"), F.lit(1).alias("corner")), F.struct(F.col(a).cast("int").alias("cell"), F.lit(0).alias("corner")))
        none = F.filter(ends, lambda e: F.lit(False))
        first = F.when(F.col(a) == 0, F.array(F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("corner")))).otherwise(none)
        last = F.when(F.col(a) == n - 1, F.array(F.struct(F.lit(n - 1).alias("cell"), F.lit(1).alias("corner")))).otherwise(none)
        rows = rows.withColumn(a, F.explode(F.concat(ends, first, last)))
    number = reduce(lambda s, ka: s + F.col(ka[1])["corner"] * 2 ** ka[0], enumerate(u.axes), F.lit(0))
    keys = [F.col(a)["cell"].alias(f"i_{a}") for a in u.axes]
    return rows.groupBy("image_id", *keys).agg(F.array_sort(F.collect_list(F.struct(number.alias("number"), "v"))).alias("corners")).select("image_id", *[f"i_{a}" for a in u.axes], F.col("corners.v").alias("corners"))


def moved_on(rows: DataFrame, u: Raster, table: DataFrame, p: list[Column]) -> DataFrame:
    """``rows`` with ``u``: the field of ``table`` at the points ``p`` by linear interpolation, zero
    outside the grid."""
    names = [f"c_{a}" for a in u.axes]
    at = rows.select("*", *[c.alias(n) for c, n in zip(index_columns(u.geometry, p), names)])
    inside = reduce(lambda s, na: s & (F.col(na[0]) >= -0.5) & (F.col(na[0]) < u.size(na[1]) - 0.5), zip(names, u.axes), F.lit(True))
    at = at.select("*", *[F.when(inside, F.floor(n)).cast("int").alias(f"i_{a}") for n, a in zip(names, u.axes)])
    got = at.join(table, ["image_id", *[f"i_{a}" for a in u.axes]], "left")
    part = [F.col(n) - F.floor(n) for n in names]

    def value(k: int) -> Column:
        terms = []
        for c in range(2**u.dim):
            w = reduce(lambda s, x: s * x, [part[j] if c >> j & 1 else 1 - part[j] for j in range(u.dim)])
            terms.append(w * F.col("corners")[c][k].cast("double"))
        return F.coalesce(reduce(lambda s, x: s + x, terms), F.lit(0.0))

    return got.select(*rows.columns, F.array(*[value(k) for k in range(u.dim)]).alias("u"))


def compose(first: Raster, then: Raster) -> Raster:
    """The displacement of going by ``first`` and, from where that leads, by ``then``."""
    p = point_columns(first.geometry, first.axes)
    rows = first.df.select(*first.keys, "v")
    got = moved_on(rows, then, cells(then), [c + F.col("v")[k] for k, c in enumerate(p)])
    return Raster(got.select(*first.keys, F.zip_with("v", "u", lambda a, b: a.cast("double") + b).alias("v")), first.geometry, first.pixel)


def invert_displacement_field(u: Raster, rounds: int = 10, largest: float = 0.1, mean: float = 0.001, hold_border: bool = True, estimate: Raster | None = None) -> tuple[Raster, DataFrame]:
    """The inverse of a displacement field, and image_id, ``largest``, ``mean`` of the last round.

    A round composes the estimate with the field and steps against what is left, by three quarters in
    the first round and by half in others; steps that are longer (in voxels) than this part of the
    longest are cut to it.  An image is done when its largest or its mean rest, measured
    before the round's step, is not above ``largest`` or ``mean``.  ``hold_border`` keeps the
    grid's border at zero.  Without ``estimate`` all begins at zero; the result has its grid.
    """
    start = estimate or u
    zero = F.array(*[F.lit(0.0)] * u.dim)
    kept = F.transform("v", lambda x: x.cast("double")) if estimate is not None else zero
    now = start.df.select(*start.keys, kept.alias("v"), F.lit(True).alias("open"))
    table, p = staged(cells(u)), point_columns(start.geometry, start.axes)
    border = reduce(lambda s, a: s | (F.col(a) == 0) | (F.col(a) == start.size(a) - 1), start.axes, F.lit(False)) if hold_border else F.lit(False)
    norms = start.df.select("image_id").distinct().select("image_id", *[F.lit(float("inf")).alias(c) for c in ("largest", "mean")])
    for k in range(rounds):
        part = 0.75 if k == 0 else 0.5
        got = moved_on(now, u, table, [c + F.col("v")[j] for j, c in enumerate(p)])
        rest = F.zip_with("v", "u", lambda a, b: a + b)
        got = got.select(*start.keys, "v", "open", rest.alias("rest"))
        norm = F.sqrt(reduce(lambda s, j: s + F.pow(F.col("rest")[j] / u.geometry.spacing[j], 2), range(u.dim), F.lit(0.0)))
        got = staged(got.withColumn("norm", norm))
        new = staged(got.where("open").groupBy("image_id").agg(F.max("norm").alias("largest"), F.avg("norm").alias("mean")))
        norms = staged(norms.join(new.select("image_id", F.col("largest").alias("l"), F.col("mean").alias("m")), "image_id", "left").select("image_id", F.coalesce("l", "largest").alias("largest"), F.coalesce("m", "mean").alias("mean")))
        bound = part * F.col("largest")
        size = part * F.when(F.col("norm") > bound, bound / F.col("norm")).otherwise(1.0)
        stepped = F.when(border, zero).otherwise(F.zip_with("v", F.transform("rest", lambda x: x * size), lambda a, b: a - b))
        open_still = F.col("open") & (F.col("largest") > largest) & (F.col("mean") > mean)
        now = staged(got.join(norms, "image_id").select(*start.keys, F.when(F.col("open"), stepped).otherwise(F.col("v")).alias("v"), open_still.alias("open")))
        if now.where("open").isEmpty():
            break
    return Raster(now.select(*start.keys, "v"), start.geometry, u.pixel), norms


def jacobian_determinant(field: Raster) -> Raster:
    """Determinant of identity plus the gradient of a displacement field of two or three dimensions."""
    from ..raster import PIXELS
    from .window import gradient

    real = PIXELS["float64"]
    parts = [gradient(Raster(field.df.withColumn("v", F.col("v")[k]), field.geometry, real)) for k in range(field.dim)]
    rows = parts[0].zip(*parts[1:])
    m = [[F.col(f"v{i}")[j] + (1.0 if i == j else 0.0) for j in range(field.dim)] for i in range(field.dim)]
    value = F.lit(0.0)
    for order in itertools.permutations(range(field.dim)):
        odd = sum(a > b for i, a in enumerate(order) for b in order[i + 1 :]) % 2
        value = value + (-1.0 if odd else 1.0) * reduce(lambda s, x: s * x, [m[i][j] for i, j in enumerate(order)])
    return Raster(rows.select(*field.keys, value.alias("v")), field.geometry, real)
