"""Super-pixels by simple linear iterative clustering (SLIC).

Voxels are staged once as dense tiles, one row each.  In a round the centres go to the tiles
that their search boxes touch (an equi-join on tiles), a tile lets its centres claim voxels,
and hands back sums for each centre, which combine before the shuffle.  Stray pieces are
found as components; a piece that is too small takes the label of the voxel before its first
one in raster order, a chain of pieces that pointer doubling resolves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..raster import Raster
from ..staging import staged
from .labels import _components

#: Voxels of a tile.
TILE_VOXELS = 1 << 16


def _nearest(c: Column) -> Column:
    """The index nearest to a coordinate, halves upwards."""
    return F.floor(c + 0.5).cast("int")


def _start(r: Raster, grid: Sequence[int]) -> DataFrame:
    """Centres on a regular grid: image_id, label, value, and a coordinate for each axis."""
    count = [max(n // g, 1) for n, g in zip(r.geometry.size, grid)]
    shift = [(n - 1) / 2 - g * (k - 1) / 2 for n, g, k in zip(r.geometry.size, grid, count)]
    first = [min(max(math.floor(s + 0.5), 0), n - 1) for s, n in zip(shift, r.geometry.size)]
    cell = {a: F.floor((F.col(a) - o) / g).cast("int") for a, o, g in zip(r.axes, first, grid)}
    on = [(F.col(a) >= o) & ((F.col(a) - o) % g == 0) & (cell[a] < k) for a, o, g, k in zip(r.axes, first, grid, count)]
    label = reduce(lambda s, ak: s * ak[1] + cell[ak[0]], reversed(list(zip(r.axes, count))), F.lit(0).cast("long"))
    place = [(cell[a] * g + F.lit(float(s))).alias(f"c_{a}") for a, g, s in zip(r.axes, grid, shift)]
    return r.df.where(reduce(lambda a, b: a & b, on)).select("image_id", label.alias("label"), F.col("v").cast("double").alias("value"), *place)


def _perturbed(r: Raster, centres: DataFrame) -> DataFrame:
    """Each centre moves to the voxel of least gradient around it.  Neighbours outside the grid
    repeat its edge; ties go to the first voxel in raster order."""
    steps = [o[::-1] for o in itertools.product((-1, 0, 1), repeat=r.dim)]
    held = lambda c, a: F.greatest(F.lit(0), F.least(c, F.lit(r.size(a) - 1)))
    probes = [F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), F.lit(float(s)).alias("sign"), *[held(_nearest(F.col(f"c_{a}")) + o[i] + (s if i == d else 0), a).cast("int").alias(a) for i, a in enumerate(r.axes)]) for k, o in enumerate(steps) for d in range(r.dim) for s in (1, -1)]
    read = centres.select("image_id", "label", F.explode(F.array(*probes)).alias("p")).select("image_id", "label", "p.*").join(r.df, r.keys)
    spacing = F.element_at(F.array(*[F.lit(2.0 * s) for s in r.geometry.spacing]), F.col("d") + 1)
    slope = read.groupBy("image_id", "label", "k", "d").agg(F.pow(F.sum(F.col("sign") * F.col("v").cast("double")) / F.first(spacing), 2).alias("g"))
    norm = slope.groupBy("image_id", "label", "k").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("d", "g"))), F.lit(0.0), lambda s, x: s + x["g"]).alias("g"))
    best = norm.groupBy("image_id", "label").agg(F.min(F.struct("g", "k")).alias("best"))
    step = lambda i: F.element_at(F.array(*[F.lit(o[i]) for o in steps]), F.col("best.k") + 1)
    moved = centres.join(best, ["image_id", "label"]).select("image_id", "label", *[held(_nearest(F.col(f"c_{a}")) + step(i), a).cast("int").alias(a) for i, a in enumerate(r.axes)])
    return moved.join(r.df, r.keys).select("image_id", "label", F.col("v").cast("double").alias("value"), *[F.col(a).cast("double").alias(f"c_{a}") for a in r.axes])


def _tiles(r: Raster, side: int) -> DataFrame:
    """One row for each tile: values, which voxels there are, and labels (all 0)."""
    size, axes = r.geometry.size, r.axes

    def pack(tile: pa.Table) -> pa.Table:
        low = [tile.column(f"tile_{a}")[0].as_py() * side for a in axes]
        shape = [min(side, n - lo) for n, lo in zip(size, low)]
        at = tuple(tile.column(a).to_numpy() - lo for a, lo in zip(axes, low))
        value, there = np.zeros(shape), np.zeros(shape, bool)
        value[at], there[at] = tile.column("v").to_numpy(), True
        keys = [tile.column(c)[:1] for c in ["image_id", *(f"tile_{a}" for a in axes)]]
        return pa.Table.from_arrays([*keys, pa.array([value.tobytes()]), pa.array([there.tobytes()]), pa.array([np.zeros(shape, np.int64).tobytes()])], names=["image_id", *(f"tile_{a}" for a in axes), "value", "there", "labels"])

    tile = [F.floor(F.col(a) / side).cast("int").alias(f"tile_{a}") for a in axes]
    rows = r.df.select(*r.keys, F.col("v").cast("double").alias("v"), *tile)
    kinds = "image_id long, " + ", ".join(f"tile_{a} int" for a in axes) + ", value binary, there binary, labels binary"
    return rows.groupBy("image_id", *[f"tile_{a}" for a in axes]).applyInArrow(pack, kinds)


def _claim(size: Sequence[int], axes: Sequence[str], grid: Sequence[int], scales: Sequence[float], side: int):
    """New labels of tiles: each centre in turn claims the voxels of its box to which it is nearer
    than any centre before.  Distances are 32-bit floats."""

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                low = [row[f"tile_{a}"] * side for a in axes]
                shape = [min(side, n - lo) for n, lo in zip(size, low)]
                value = np.frombuffer(row["value"]).reshape(shape)
                labels = np.frombuffer(row["labels"], np.int64).reshape(shape).copy()
                least = np.full(shape, np.finfo(np.float32).max, np.float32)
                for c in sorted(row["centres"] or [], key=lambda c: c["label"]):
                    middle = [math.floor(c[f"c_{a}"] + 0.5) for a in axes]
                    first = [max(m - g - lo, 0) for m, g, lo in zip(middle, grid, low)]
                    last = [min(m + g - lo + 1, n) for m, g, lo, n in zip(middle, grid, low, shape)]
                    if any(f >= z for f, z in zip(first, last)):
                        continue
                    box = tuple(map(slice, first, last))
                    d = (c["value"] - value[box]).astype(np.float32)
                    total = d * d
                    for k, a in enumerate(axes):
                        d = ((c[f"c_{a}"] - np.arange(first[k] + low[k], last[k] + low[k])) * scales[k]).astype(np.float32)
                        total = total + (d * d).reshape([-1 if j == k else 1 for j in range(len(axes))])
                    nearer = total < least[box]
                    least[box] = np.where(nearer, total, least[box])
                    labels[box] = np.where(nearer, c["label"], labels[box])
                out.append(labels.tobytes())
            kept = [b.column(c) for c in ["image_id", *(f"tile_{a}" for a in axes), "value", "there"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], names=["image_id", *(f"tile_{a}" for a in axes), "value", "there", "labels"])

    return claim


def _voxels(size: Sequence[int], axes: Sequence[str], side: int, sums: bool):
    """Tiles as voxels with their labels, or as sums of the voxels of each label."""

    def voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                low = [row[f"tile_{a}"] * side for a in axes]
                shape = [min(side, n - lo) for n, lo in zip(size, low)]
                there = np.frombuffer(row["there"], bool)
                labels = np.frombuffer(row["labels"], np.int64)[there]
                at = [(x.ravel() + lo)[there] for x, lo in zip(np.indices(shape), low)]
                if not sums:
                    image = np.full(len(labels), row["image_id"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(image), *(pa.array(x.astype(np.int32)) for x in at), pa.array(labels)], names=["image_id", *axes, "v"])
                    continue
                label, j = np.unique(labels, return_inverse=True)
                total = [np.bincount(j, x, len(label)) for x in (np.frombuffer(row["value"])[there], *at)]
                image = np.full(len(label), row["image_id"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(image), pa.array(label), *map(pa.array, total), pa.array(np.bincount(j, minlength=len(label)))], names=["image_id", "label", "value", *(f"c_{a}" for a in axes), "n"])

    return voxels


def _connected(r: Raster, labels: Raster, centres: DataFrame, grid: Sequence[int], clusters: int) -> DataFrame:
    """Keys and final label: one piece of each cluster keeps its label, other pieces of a quarter of
    a cell or more get new ones in raster order, the rest take the label of the voxel before."""
    least, count = math.prod(grid) // 4, r.geometry.count
    rows = staged(_components(labels, labels.df, F.col("v") == F.col("w"), False, lambda v, w: v == w).select(*r.keys, F.col("v").alias("label"), "root"))
    pieces = staged(rows.groupBy("image_id", "root").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("size")))
    middle = [_nearest(F.col(f"c_{a}")) for a in r.axes]
    near = centres.select("image_id", "label", *[m.alias(f"m_{a}") for m, a in zip(middle, r.axes)])
    inside = reduce(lambda x, y: x & y, [F.abs(F.col(a) - F.col(f"m_{a}")) <= g // 2 for a, g in zip(r.axes, grid)])
    exact = reduce(lambda x, y: x & y, [F.col(a) == F.col(f"m_{a}") for a in r.axes])
    met = rows.join(near, ["image_id", "label"]).where(inside | exact)
    seeds = met.groupBy("image_id", "label").agg(F.min_by("root", F.struct(~exact, r.pos)).alias("root"))
    kept = pieces.join(seeds.select("image_id", "root", F.lit(True).alias("seeded")), ["image_id", "root"], "left")
    kept = kept.withColumn("kept", F.coalesce("seeded", F.lit(False)) & (F.col("size") >= least))
    fresh = kept.where(~F.col("kept") & (F.col("size") >= least)).select("image_id", "root", (F.row_number().over(Window.partitionBy("image_id").orderBy("root")) + F.lit(clusters - 1)).cast("long").alias("fresh"))
    known = kept.join(fresh, ["image_id", "root"], "left").select("image_id", "root", F.when(F.col("kept"), F.col("label")).otherwise(F.col("fresh")).alias("final"))
    before = known.where("final is null").select("image_id", "root", (F.col("root") - F.col("image_id") * F.lit(count) - 1).alias("before"))
    behind = rows.select("image_id", r.pos.alias("before"), F.col("root").alias("next"))
    now = staged(known.join(before.join(behind, ["image_id", "before"]).select("image_id", "root", "next"), ["image_id", "root"], "left").withColumn("final", F.when(F.col("final").isNull() & F.col("next").isNull(), F.lit(clusters)).otherwise(F.col("final"))))
    while not now.where("final is null").isEmpty():
        ahead = now.select("image_id", F.col("root").alias("next"), F.col("final").alias("then"), F.col("next").alias("further"))
        now = staged(now.join(ahead, ["image_id", "next"], "left").select("image_id", "root", F.coalesce("final", "then").alias("final"), F.when(F.col("final").isNull() & F.col("then").isNull(), F.col("further")).alias("next")))
    return rows.join(now.select("image_id", "root", "final"), ["image_id", "root"])


def slic(r: Raster, grid: Sequence[int], weight: float = 10.0, rounds: int = 5, connected: bool = True, perturb: bool = True, tile: int = TILE_VOXELS) -> tuple[Raster, DataFrame]:
    """Labels of super-pixels about as large as ``grid``, and ``image_id``, ``average_residual``.

    A cluster is a mean value and a mean index; a voxel belongs to the cluster least far in value
    and, weighted by ``weight`` over the grid's size, in place, among those whose rounded centre
    is within ``grid`` on every axis (ties: the smaller label).  Labels start at 0 and may have
    gaps.  Clusters without voxels end, and make the residual NaN; without rounds all labels
    are 0 and the residual is the largest double.
    """
    if len(grid) < r.dim or any(g < 1 for g in grid):
        raise ValueError("the grid needs a size of 1 or more for each axis")
    grid = list(grid[: r.dim])
    side = max(2, round(tile ** (1 / r.dim)))
    scales = [weight / g for g in grid]
    clusters = math.prod(max(n // g, 1) for n, g in zip(r.geometry.size, grid))
    centres = _start(r, grid)
    centres = staged(_perturbed(r, centres) if perturb and min(grid) >= 3 else centres)
    tiles = staged(_tiles(r, side))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema)
    keys = ["image_id", *(f"tile_{a}" for a in r.axes)]
    residual = centres.select("image_id").distinct().withColumn("average_residual", F.lit(float(np.finfo(np.float64).max)))
    for _ in range(rounds):
        reach = centres
        for a, g in zip(r.axes, grid):
            middle = _nearest(F.col(f"c_{a}"))
            low, high = F.floor((middle - g) / side), F.floor((middle + g) / side)
            reach = reach.withColumn(f"tile_{a}", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit((r.size(a) - 1) // side)).cast("int"))))
        reach = reach.groupBy(*keys).agg(F.collect_list(F.struct("label", "value", *[f"c_{a}" for a in r.axes])).alias("centres"))
        tiles = staged(tiles.join(reach, keys, "left").mapInArrow(_claim(r.geometry.size, r.axes, grid, scales, side), kinds))
        columns = ["value", *(f"c_{a}" for a in r.axes)]
        parts = tiles.mapInArrow(_voxels(r.geometry.size, r.axes, side, True), "image_id long, label long, " + ", ".join(f"{c} double" for c in columns) + ", n long")
        new = staged(parts.groupBy("image_id", "label").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in columns]))
        moved = centres.select("image_id", "label", *[F.col(c).alias(f"was_{c}") for c in columns]).join(new, ["image_id", "label"], "left")
        far = reduce(lambda s, x: s + x * x, [((F.col(c) - F.col(f"was_{c}")) * s).cast("float") for c, s in zip(columns, [1.0, *scales])], F.lit(0.0).cast("float"))
        average = F.when(F.count("value") == clusters, F.sqrt(F.sum(far.cast("double"))) / (clusters * (1 + r.dim))).otherwise(F.lit(float("nan")))
        residual = moved.groupBy("image_id").agg(average.alias("average_residual"))
        centres = new
    rows = tiles.mapInArrow(_voxels(r.geometry.size, r.axes, side, False), "image_id long, " + ", ".join(f"{a} int" for a in r.axes) + ", v long")
    labels = r.with_rows(rows, pixel="uint32")
    if connected:
        labels = r.with_rows(_connected(r, labels, centres, grid, clusters).withColumn("v", F.col("final")), pixel="uint32")
    return labels, residual
