"""Region growing with statistics, watersheds and arrival times, as staged rounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..raster import PIXELS, Raster
from ..staging import staged
from .labels import TILE_VOXELS, connected_component, connected_threshold
from .window import taps


def _at(r: Raster, seeds: Sequence[Sequence[int]]) -> Column:
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(x) == i for x, i in zip(r.axes, s)]) for s in seeds])


def confidence_connected(r: Raster, seeds: Sequence[Sequence[int]], multiplier: float = 2.5, iterations: int = 4, radius: int = 1) -> Raster:
    """Grow within mean +- multiplier * sigma of the image's own region, starting from the seeds' boxes."""
    near = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.abs(F.col(x) - i) <= radius for x, i in zip(r.axes, s)]) for s in seeds])
    v = F.col("v").cast("double")
    stats = lambda rows: rows.groupBy("image_id").agg(F.avg(v).alias("m"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("d"))
    bounds, region = stats(r.df.where(near)), None
    for _ in range(iterations + 1):
        reach = multiplier * F.col("d")
        inside = r.df.join(bounds, "image_id").withColumn("v", F.when(v.between(F.col("m") - reach, F.col("m") + reach), 1).otherwise(0))
        region = connected_threshold(r.with_rows(inside, pixel="uint8"), seeds, 1, 1)
        region = region.with_rows(staged(region.df))
        bounds = stats(r.zip(region).where("v1 = 1").select("image_id", F.col("v0").alias("v")))
        bounds = staged(region.df.select("image_id").distinct().join(bounds, "image_id", "left"))
    return region


def neighborhood_connected(r: Raster, seeds: Sequence[Sequence[int]], lower: float, upper: float, radius: Sequence[int]) -> Raster:
    """Grow over voxels whose whole box is within range."""
    box = taps(r, radius, "crop").df
    ok = F.forall("v", lambda x: (x >= lower) & (x <= upper))
    marks = r.with_rows(box.select(*r.keys, F.when(ok, 1).otherwise(0).alias("v")), pixel="uint8")
    return connected_threshold(marks, seeds, 1, 1)


def isolated_connected(r: Raster, seed: Sequence[int], other: Sequence[int], lower: float, upper: float, tolerance: float = 1) -> tuple[Raster, float]:
    """The largest upper threshold, by bisection, at which the seed's region leaves ``other`` out."""
    low, high = lower, upper
    while high - low > tolerance:
        guess = (low + high) / 2
        hit = connected_threshold(r, [seed], lower, guess).df.where(_at(r, [other]) & (F.col("v") == 1)).count()
        low, high = (low, guess) if hit else (guess, high)
    return connected_threshold(r, [seed], lower, low), low


def _sweep(rows, r: Raster, better, columns: Sequence[str]):
    """One exchange with the axis neighbours: keeps the least of ``better`` candidates."""
    for a in r.axes:
        line = r.line(a)
        found = F.struct(*columns)
        rows = rows.withColumn("low", F.lag(found).over(line)).withColumn("high", F.lead(found).over(line))
        rows = better(rows, a).drop("low", "high")
    return rows


def watershed_from_markers(r: Raster, markers: Raster) -> Raster:
    """Flooding from labelled markers: every voxel takes the label that reaches it over the lowest
    pass, then in the fewest steps, then of smallest number.  Rounds are staged."""
    top = float("inf")
    rows = r.zip(markers).select(*r.keys, F.col("v0").cast("double").alias("h"), F.when(F.col("v1") != 0, F.col("v0").cast("double")).otherwise(top).alias("p"), F.when(F.col("v1") != 0, 0).otherwise(1 << 30).alias("d"), F.col("v1").cast("long").alias("l"), (F.col("v1") != 0).alias("fixed"))

    def better(df, _axis):
        own = F.struct("p", "d", "l")
        via = lambda c: F.when(F.col(c).isNotNull() & (F.col(c)["l"] != 0), F.struct(F.greatest(F.col(c)["p"], F.col("h")).alias("p"), (F.col(c)["d"] + 1).alias("d"), F.col(c)["l"].alias("l")))
        best = F.when(F.col("fixed"), own).otherwise(F.least(own, via("low"), via("high")))
        return df.withColumn("b", best).withColumn("p", F.col("b.p")).withColumn("d", F.col("b.d")).withColumn("l", F.col("b.l")).drop("b")

    now = staged(rows)
    while True:
        now = staged(_sweep(now.withColumn("before", F.struct("p", "d", "l")), r, better, ("p", "d", "l")))
        if now.where(~F.struct("p", "d", "l").eqNullSafe(F.col("before"))).isEmpty():  # NaN equals NaN
            return r.with_rows(now.select(*r.keys, F.col("l").alias("v")), pixel="uint32")
        now = now.drop("before")


def watershed(r: Raster, level: float = 0) -> Raster:
    """Flooding from the regional minima that are deeper than ``level``."""
    from .morphology import h_minima, reconstruction

    filled = h_minima(r, level) if level else r
    filled = filled.with_rows(staged(filled.df))
    raised = reconstruction(filled.map(lambda v: v.cast("double") + 1), filled, "erosion")
    minima = filled.with_rows(filled.zip(raised).withColumn("v", F.when(F.col("v1") > F.col("v0"), 1).otherwise(0)), pixel="uint8")
    return watershed_from_markers(r, connected_component(minima))


def _sides(size: Sequence[int], voxels: int) -> list[int]:
    """Sides of tiles of at most ``voxels`` voxels: as long as the grid where it is short."""
    sides = [1] * len(size)
    order = sorted(range(len(size)), key=lambda k: size[k])
    for done, k in enumerate(order):
        sides[k] = min(size[k], max(2, int(voxels ** (1 / (len(size) - done)))))
        voxels = max(1, voxels // sides[k])
    return sides


def _march(axes: Sequence[str], sides: Sequence[int], size: Sequence[int], spacing: Sequence[float], stop: float):
    """The arrival times ``t`` of one tile, settled from its own and its halo's (front speed ``f``); of
    the tile's own voxels: keys, speed, time, and whether a time fell that another tile's halo has."""
    weight = [1 / (h * h) for h in spacing]

    def march(tile: pa.Table) -> pa.Table:
        low = [tile.column(f"tile_{a}")[0].as_py() * n for a, n in zip(axes, sides)]
        shape = [n + 2 for n in sides]
        step = [int(np.prod(shape[k + 1 :])) for k in range(len(shape))]
        place = sum((tile.column(a).to_numpy() - lo + 1).astype(np.int64) * by for a, lo, by in zip(axes, low, step))
        speed, time = np.zeros(int(np.prod(shape))), np.full(int(np.prod(shape)), np.inf)
        own = tile.column("own").to_numpy()
        given = tile.column("f").to_numpy()
        speed[place] = np.where(own & (given > 0), given, 0.0)  # the halo's times are given
        time[place] = tile.column("t").to_numpy()
        with np.errstate(divide="ignore"):
            slow = (1 / speed).tolist()
        t, neighbours = time.tolist(), [k for by in step for k in (by, -by)]
        front = [(t[i], i) for i in place[(time[place] < np.inf) & (~own | (time[place] == 0))].tolist()]
        heapq.heapify(front)
        while front:
            now, i = heapq.heappop(front)
            if now > t[i]:
                continue
            for k in neighbours:
                j = i + k
                if not 0 <= j < len(t) or slow[j] == math.inf or t[j] <= now:
                    continue
                known = sorted((min(t[j - by], t[j + by]), w) for by, w in zip(step, weight))
                a = b = 0.0
                c = -slow[j] * slow[j]
                root = math.inf
                for x, w in known:  # the axes that the front comes from, nearest first
                    if x > root or x == math.inf:
                        break
                    a, b, c = a + w, b + x * w, c + x * x * w
                    disc = b * b - a * c
                    if disc < 0:
                        break
                    root = min(root, (b + math.sqrt(disc)) / a)
                if root <= stop and t[j] - root > 1e-12 * (1 + root):
                    t[j] = root
                    heapq.heappush(front, (root, j))
        after = np.array(t)[place]
        edge = np.zeros(len(place), bool)
        for a, lo, n, last in zip(axes, low, sides, size):
            at = tile.column(a).to_numpy()
            edge |= ((at == lo) & (lo > 0)) | ((at == lo + n - 1) & (at < last - 1))
        fell = edge & (after < tile.column("t").to_numpy())
        out = tile.drop_columns([f"tile_{a}" for a in axes]).set_column(tile.schema.get_field_index("t"), "t", pa.array(after)).append_column("fell", pa.array(fell))
        return out.filter(tile.column("own")).drop_columns(["own"])

    return march


def fast_marching(speed: Raster, seeds: Sequence[Sequence[int]], stop: float = float("inf")) -> Raster:
    """First arrival times of a front from the seeds: the upwind eikonal equation.  Zero speed is
    never reached.

    A round settles every tile for itself, a bounded block of voxels with the voxels beside
    it; the next one passes on the times that fell at tile borders, so the rounds follow the
    number of tiles that the front crosses.  Rounds are staged.
    """
    sides = _sides(speed.geometry.size, TILE_VOXELS)
    f = F.col("v").cast("double")
    now = speed.df.select(*speed.keys, F.when(f > 0, F.nanvl(f, F.lit(0.0))).otherwise(0.0).alias("f"), F.when(_at(speed, seeds), 0.0).otherwise(float("inf")).alias("t"))
    kinds = "image_id long, " + ", ".join(f"{a} int" for a in speed.axes) + ", f double, t double, fell boolean"
    march = _march(speed.axes, sides, speed.geometry.size, speed.geometry.spacing, stop)
    while True:
        rows = now.withColumn("own", F.lit(True))
        for a, n in zip(speed.axes, sides):
            rows = rows.withColumn(f"tile_{a}", F.floor(F.col(a) / n).cast("int"))
        halo = []
        for a, n in zip(speed.axes, sides):  # a voxel at a tile's border also goes to the tile behind it
            c = F.col(a)
            halo += [F.when((c % n == 0) & (c > 0), F.struct(F.lit(False).alias("own"), *[(F.col(f"tile_{b}") - (1 if a == b else 0)).alias(f"tile_{b}") for b in speed.axes]))]
            halo += [F.when((c % n == n - 1) & (c < speed.size(a) - 1), F.struct(F.lit(False).alias("own"), *[(F.col(f"tile_{b}") + (1 if a == b else 0)).alias(f"tile_{b}") for b in speed.axes]))]
        here = F.struct("own", *[f"tile_{a}" for a in speed.axes])
        rows = rows.select(*speed.keys, "f", "t", F.explode(F.array_compact(F.array(here, *halo))).alias("to")).select(*speed.keys, "f", "t", "to.*")
        done = staged(rows.groupBy("image_id", *[f"tile_{a}" for a in speed.axes]).applyInArrow(march, kinds))
        now = done.drop("fell")
        if all(n >= size for n, size in zip(sides, speed.geometry.size)) or done.where("fell").isEmpty():
            return Raster(now.select(*speed.keys, F.col("t").alias("v")), speed.geometry, PIXELS["float64"])
