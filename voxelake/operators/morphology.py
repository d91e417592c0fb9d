"""Mathematical morphology: windows over boxes and crosses, and reconstruction as a fixpoint."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..raster import PIXELS, Pixel, Raster
from ..staging import staged
from .window import _filter, blocks, box_sum, exact_in_double, plane_only, taps


def element(shape: str, radius: Sequence[int]) -> list[int]:
    """Positions (0-based, in a box's raster order) of a structuring element: ``box``, ``cross``
    or ``ball`` (voxels whose centre is inside the ellipsoid of half-axes radius + 1/2)."""
    box = list(itertools.product(*[range(-k, k + 1) for k in reversed(radius)]))
    keep = {
        "box": lambda o: True,
        "cross": lambda o: sum(x != 0 for x in o) <= 1,
        "ball": lambda o: sum((x / (k + 0.5)) ** 2 for x, k in zip(o, reversed(radius))) <= 1,
    }[shape]
    return [i for i, o in enumerate(box) if keep(o)]


def _pick(w: Column, at: list[int]) -> Column:
    return F.array(*[F.element_at(w, i + 1) for i in at])


def _extreme(r: Raster, radius: Sequence[int], shape: str, largest: bool) -> Raster:
    """Maximum or minimum over the element; outside the grid nothing counts.  A box is one pass
    of comparisons for each axis."""
    if not exact_in_double(r):
        rows = taps(r, radius, "null").df
        return r.with_rows(rows.withColumn("v", (F.array_max if largest else F.array_min)(_pick(F.col("v"), element(shape, radius)))))
    best = np.fmax if largest else np.fmin
    sides = [2 * k + 1 for k in radius]
    steps = None if shape == "box" else [np.unravel_index(i, sides[::-1])[::-1] for i in element(shape, radius)]

    def kernel(block: np.ndarray) -> np.ndarray:
        if steps is not None:
            return reduce(best, [block[tuple(slice(i, i + n - m + 1) for i, n, m in zip(o, block.shape, sides))] for o in steps])
        for k, m in enumerate(sides):
            block = reduce(best, [block[tuple(slice(i, i + block.shape[k] - m + 1) if j == k else slice(None) for j in range(block.ndim))] for i in range(m)])
        return block

    return blocks(r, radius, kernel, "nan")


def grayscale_erode(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    """Minimum over the element; outside the grid nothing counts."""
    return _extreme(r, radius, shape, False)


def grayscale_dilate(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return _extreme(r, radius, shape, True)


def morphological_gradient(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    at = element(shape, radius)
    return _filter(r, radius, lambda w: F.array_max(_pick(w, at)) - F.array_min(_pick(w, at)), "null")


def grayscale_opening(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return grayscale_dilate(grayscale_erode(r, radius, shape), radius, shape)


def grayscale_closing(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return grayscale_erode(grayscale_dilate(r, radius, shape), radius, shape)


def white_top_hat(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return r - grayscale_opening(r, radius, shape)


def black_top_hat(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return grayscale_closing(r, radius, shape) - r


def binary_dilate(r: Raster, radius: Sequence[int], shape: str = "box", foreground: int = 1) -> Raster:
    """Foreground where the element meets it; other values stay elsewhere."""
    met = grayscale_dilate(r.map(lambda v: F.when(v == foreground, 1).otherwise(0), "uint8"), radius, shape)
    return r.with_rows(r.zip(met).withColumn("v", F.when(F.col("v1") == 1, foreground).otherwise(F.col("v0"))))


def binary_erode(r: Raster, radius: Sequence[int], shape: str = "box", foreground: int = 1, background: int = 0, border_foreground: bool = True) -> Raster:
    """Foreground stays where the whole element is foreground; eroded voxels become background."""
    n = element("box", radius)
    centre = F.element_at(F.col("v"), len(n) // 2 + 1)
    at = element(shape, radius)
    return _filter(r, radius, lambda w: F.when(centre != foreground, centre).when(F.forall(_pick(w, at), lambda x: F.coalesce(x == foreground, F.lit(border_foreground))), foreground).otherwise(background), "null")


def binary_opening(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return binary_dilate(binary_erode(r, radius, shape), radius, shape)


def binary_closing(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return binary_erode(binary_dilate(r, radius, shape), radius, shape)


def _count(r: Raster, radius: Sequence[int], foreground: float) -> Raster:
    """Foreground voxels in the box with a repeated edge."""
    return box_sum(r.map(lambda v: F.when(v == foreground, 1.0).otherwise(0.0), "float64"), radius, "clamp")


def voting_binary(r: Raster, radius: Sequence[int], birth: int = 1, survival: int = 1, foreground: int = 1, background: int = 0) -> Raster:
    """Background turns to foreground with ``birth`` foreground voxels around, foreground stays with
    ``survival`` others."""
    rows = r.zip(_count(r, radius, foreground))
    value = F.when((F.col("v0") == background) & (F.col("v1") >= birth), foreground).when((F.col("v0") == foreground) & (F.col("v1") - 1 < survival), background).otherwise(F.col("v0"))
    return r.with_rows(rows.withColumn("v", value))


def voting_hole_filling(r: Raster, radius: Sequence[int], majority: int = 1, foreground: int = 1, background: int = 0) -> Raster:
    """Background turns to foreground if more than half the other voxels, and ``majority`` more, are."""
    n = reduce(lambda a, b: a * b, [2 * k + 1 for k in radius])
    rows = r.zip(_count(r, radius, foreground))
    value = F.when((F.col("v0") == background) & (F.col("v1") >= (n - 1) // 2 + majority), foreground).otherwise(F.col("v0"))
    return r.with_rows(rows.withColumn("v", value))


def voting_iterative_hole_filling(r: Raster, radius: Sequence[int], majority: int = 1, rounds: int = 10) -> Raster:
    """Repeated filling until nothing changes, at most ``rounds`` times."""
    now = r
    for _ in range(rounds):
        new = voting_hole_filling(now, radius, majority)
        new = new.with_rows(staged(new.df))
        if not now.zip(new).where("v0 <> v1").limit(1).count():
            return new
        now = new
    return now


def binary_median(r: Raster, radius: Sequence[int], foreground: int = 1, background: int = 0) -> Raster:
    n = reduce(lambda a, b: a * b, [2 * k + 1 for k in radius])
    return r.with_rows(_count(r, radius, foreground).df.withColumn("v", F.when(F.col("v") > n // 2, foreground).otherwise(background)))


def _contour(r: Raster, fully_connected: bool) -> Raster:
    """Voxels that are not 0 and touch another value; others become 0."""
    if not exact_in_double(r):
        at, v = element("box" if fully_connected else "cross", [1] * r.dim), F.element_at(F.col("v"), 3**r.dim // 2 + 1)
        touches = lambda w: F.exists(_pick(w, at), lambda x: F.coalesce((v != 0) & (x != v), F.lit(False)))
        return _filter(r, [1] * r.dim, lambda w: F.when(touches(w), v).otherwise(0), "null")
    steps = [o for o in itertools.product((0, 1, 2), repeat=r.dim) if fully_connected or sum(k != 1 for k in o) == 1]

    def kernel(block: np.ndarray) -> np.ndarray:
        own = block[(slice(1, -1),) * block.ndim]
        touches = np.zeros(own.shape, bool)
        for o in steps:
            other = block[tuple(slice(k, k + n) for k, n in zip(o, own.shape))]
            touches |= (other != own) & ~np.isnan(other)
        return np.where(touches & (own != 0), own, 0)

    return blocks(r, [1] * r.dim, kernel, "nan")


def binary_contour(r: Raster, foreground: int = 1, fully_connected: bool = False) -> Raster:
    """Foreground voxels that touch another value."""
    return _contour(r.map(lambda v: F.when(v == foreground, foreground).otherwise(0)), fully_connected)


def label_contour(r: Raster, fully_connected: bool = False) -> Raster:
    """Labelled voxels that touch another label."""
    return _contour(r, fully_connected)


# Reconstruction


def _spread(axes: Sequence[str], side: int, offsets: Sequence[Sequence[int]]):
    """The marker ``v`` of one tile and its halo spread under the mask ``m`` until nothing changes;
    of the tile's own voxels: keys, mask, value, and whether it rose."""

    def spread(tile: pa.Table) -> pa.Table:
        corner = [tile.column(f"tile_{a}")[0].as_py() * side - 2 for a in axes]
        at = tuple(tile.column(a).to_numpy() - c for a, c in zip(axes, corner))
        whole = pa.types.is_integer(tile.column("v").type)
        mask = np.full([side + 4] * len(axes), np.iinfo(np.int64).min if whole else -np.inf)
        value = mask.copy()
        mask[at], value[at] = tile.column("m").to_numpy(), tile.column("v").to_numpy()
        inner = tuple(slice(1, -1) for _ in axes)
        while True:
            best = value[inner].copy()
            for o in offsets:
                np.fmax(best, value[tuple(slice(1 + k, side + 3 + k) for k in o)], out=best)
            np.fmin(best, mask[inner], out=best)
            if np.array_equal(best, value[inner], equal_nan=not whole):
                break
            value[inner] = best
        before, after = tile.column("v").to_numpy(), value[at]
        rose = (before != after) & (whole or ~(np.isnan(before) & np.isnan(after)))
        out = tile.drop_columns([f"tile_{a}" for a in axes]).set_column(tile.schema.get_field_index("v"), "v", pa.array(after)).append_column("rose", pa.array(rose))
        return out.filter(tile.column("own")).drop_columns(["own"])

    return spread


def _ordered(pixel: Pixel, rising: bool) -> tuple[Callable[[Column], Column], Callable[[Column], Column], str]:
    """Values as numbers that compare as they do (or the other way round), the way back, and the
    numbers' type: long for integers of 64 bits, which doubles cannot hold, else double."""
    if pixel.name not in ("int64", "uint64"):
        turned = lambda c: c if rising else -c
        return lambda c: turned(c.cast("double")), turned, "double"
    turned = lambda c: c if rising else F.bitwise_not(c)
    if pixel.name == "int64":
        return lambda c: turned(c.cast("long")), turned, "long"
    middle = F.lit(str(2**63)).cast("decimal(21,0)")
    return lambda c: turned((c.cast("decimal(21,0)") - middle).cast("long")), lambda c: turned(c).cast("decimal(21,0)") + middle, "long"


def reconstruction(marker: Raster, mask: Raster, by: str = "dilation", fully_connected: bool = False) -> Raster:
    """Geodesic reconstruction: the marker spreads under the mask until nothing changes.

    A round settles every tile for itself, a bounded block of voxels with the voxels around
    it; the next one passes on what came over tile borders, so the rounds follow the number
    of tiles that the longest path crosses.  Rounds are staged.  ``erosion`` is the dual.
    """
    from .labels import TILE_VOXELS, _offsets

    side = max(2, round(TILE_VOXELS ** (1 / mask.dim)))
    ahead = _offsets(mask.dim, fully_connected)
    offsets = [*ahead, *(tuple(-k for k in o) for o in ahead)]
    into, back, kind = _ordered(mask.pixel, by == "dilation")
    now = mask.zip(marker).select(*mask.keys, into(F.col("v0")).alias("m"), F.least(into(F.col("v0")), into(F.col("v1"))).alias("v"))
    tile = lambda c: F.floor(c / side).cast("int")
    kinds = "image_id long, " + ", ".join(f"{a} int" for a in mask.axes) + f", m {kind}, v {kind}, rose boolean"
    while True:
        rows = now
        for a in mask.axes:  # a voxel at a tile's border also goes to the tile behind it
            c = F.col(a)
            rows = rows.withColumn(f"tile_{a}", F.explode(F.array_distinct(F.array(tile(c), tile(F.greatest(c - 1, F.lit(0))), tile(F.least(c + 1, F.lit(mask.size(a) - 1)))))))
        rows = rows.withColumn("own", reduce(lambda x, y: x & y, [F.col(f"tile_{a}") == tile(F.col(a)) for a in mask.axes]))
        done = staged(rows.groupBy("image_id", *[f"tile_{a}" for a in mask.axes]).applyInArrow(_spread(mask.axes, side, offsets), kinds))
        now = done.drop("rose")
        if max(mask.geometry.size) <= side or done.where("rose").isEmpty():
            return mask.with_rows(now.withColumn("v", back(F.col("v"))))


def _border(r: Raster) -> Column:
    return reduce(lambda a, b: a | b, [(F.col(a) == 0) | (F.col(a) == r.size(a) - 1) for a in r.axes])


def grayscale_fillhole(r: Raster) -> Raster:
    """Minima that are not connected to the border rise to their rim."""
    top = r.df.groupBy("image_id").agg(F.max("v").alias("top"))
    marker = r.with_rows(r.df.join(top, "image_id").withColumn("v", F.when(_border(r), F.col("v")).otherwise(F.col("top"))))
    return reconstruction(marker, r, "erosion")


def grayscale_grindpeak(r: Raster) -> Raster:
    low = r.df.groupBy("image_id").agg(F.min("v").alias("low"))
    marker = r.with_rows(r.df.join(low, "image_id").withColumn("v", F.when(_border(r), F.col("v")).otherwise(F.col("low"))))
    return reconstruction(marker, r)


def h_maxima(r: Raster, h: float) -> Raster:
    return reconstruction(r.map(lambda v: v.cast("double") - h), r)


def h_minima(r: Raster, h: float) -> Raster:
    return reconstruction(r.map(lambda v: v.cast("double") + h), r, "erosion")


def h_convex(r: Raster, h: float) -> Raster:
    return r - h_maxima(r, h)


def h_concave(r: Raster, h: float) -> Raster:
    return h_minima(r, h) - r


def opening_by_reconstruction(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return reconstruction(grayscale_erode(r, radius, shape), r)


def closing_by_reconstruction(r: Raster, radius: Sequence[int], shape: str = "box") -> Raster:
    return reconstruction(grayscale_dilate(r, radius, shape), r, "erosion")


def binary_fillhole(r: Raster, foreground: int = 1) -> Raster:
    """Background that does not reach the border becomes foreground."""
    mask = r.map(lambda v: F.when(v == foreground, 1).otherwise(0))
    filled = grayscale_fillhole(mask)
    return r.with_rows(r.zip(filled).withColumn("v", F.when(F.col("v1") == 1, foreground).otherwise(F.col("v0"))))


def binary_grind_peak(r: Raster, foreground: int = 1, background: int = 0) -> Raster:
    mask = r.map(lambda v: F.when(v == foreground, 1).otherwise(0))
    ground = grayscale_grindpeak(mask)
    return r.with_rows(r.zip(ground).withColumn("v", F.when((F.col("v0") == foreground) & (F.col("v1") == 0), background).otherwise(F.col("v0"))))


def binary_reconstruction(marker: Raster, mask: Raster, foreground: int = 1) -> Raster:
    """Components of the mask that the marker meets."""
    return reconstruction(marker.map(lambda v: F.when(v == foreground, 1).otherwise(0)), mask.map(lambda v: F.when(v == foreground, 1).otherwise(0)))


def binary_reconstruction_by_erosion(marker: Raster, mask: Raster, foreground: int = 1) -> Raster:
    """The dual on the complement: background of the mask that the marker's background meets stays
    background, all else is foreground (1, else 0)."""
    away = lambda r: r.map(lambda v: F.when(v == foreground, 0).otherwise(1))
    met = reconstruction(away(marker), away(mask))
    return mask.with_rows(met.df.withColumn("v", 1 - F.col("v")))


def binary_opening_by_reconstruction(r: Raster, radius: Sequence[int], shape: str = "box", foreground: int = 1, background: int = 0) -> Raster:
    """Components of the foreground that survive an erosion, whole; others become background."""
    kept = binary_reconstruction(binary_erode(r, radius, shape, foreground, background), r, foreground)
    return r.with_rows(r.zip(kept).withColumn("v", F.when((F.col("v0") == foreground) & (F.col("v1") == 0), background).otherwise(F.col("v0"))))


def binary_closing_by_reconstruction(r: Raster, radius: Sequence[int], shape: str = "box", foreground: int = 1) -> Raster:
    """Background that a dilation leaves no voxel of becomes foreground, whole components only."""
    filled = binary_reconstruction_by_erosion(binary_dilate(r, radius, shape, foreground), r, foreground)
    return r.with_rows(r.zip(filled).withColumn("v", F.when(F.col("v1") == 1, foreground).otherwise(F.col("v0"))))


def valued_regional_extrema(r: Raster, maxima: bool = True, fully_connected: bool = False) -> Raster:
    """Regional extrema keep their value; all other voxels take the type's lowest (``maxima``) or
    highest value (reals: minus or plus the largest)."""
    low, high = (r.pixel.low, r.pixel.high) if r.pixel.integer else (-3.4028234663852886e38, 3.4028234663852886e38) if r.pixel.name == "float32" else (-1.7976931348623157e308, 1.7976931348623157e308)
    marks = regional_extrema(r, maxima, fully_connected)
    return r.with_rows(r.zip(marks).withColumn("v", F.when(F.col("v1") == 1, F.col("v0")).otherwise(F.lit(low if maxima else high).cast(r.pixel.spark))))


def _paint_from_boundary(r: Raster, radius: Sequence[int], shape: str, value: int, paint: int) -> Raster:
    """Paints the element around every voxel of ``value`` that has another value in its 3-box."""
    inside = F.element_at("v", 3**r.dim // 2 + 1)
    rim = taps(r, [1] * r.dim, "null").df.select(*r.keys, F.when((inside == value) & F.exists("v", lambda x: F.coalesce(x != value, F.lit(False))), 1).otherwise(0).alias("v"))
    near = grayscale_dilate(Raster(rim, r.geometry, PIXELS["uint8"]), radius, shape)
    return r.with_rows(r.zip(near).withColumn("v", F.when(F.col("v1") == 1, paint).otherwise(F.col("v0"))))


def dilate_object_morphology(r: Raster, radius: Sequence[int], value: int = 1, shape: str = "box") -> Raster:
    """The object grows by the element around its boundary voxels; other values stay elsewhere."""
    return _paint_from_boundary(r, radius, shape, value, value)


def erode_object_morphology(r: Raster, radius: Sequence[int], value: int = 1, background: int = 0, shape: str = "box") -> Raster:
    """Background is painted by the element around the object's boundary voxels."""
    return _paint_from_boundary(r, radius, shape, value, background)


def geodesic_dilate(marker: Raster, mask: Raster, shape: str = "cross") -> Raster:
    """One step: the marker's dilation held under the mask."""
    grown = grayscale_dilate(marker, [1] * marker.dim, shape)
    return mask.with_rows(mask.zip(grown).withColumn("v", F.least("v0", "v1")))


def geodesic_erode(marker: Raster, mask: Raster, shape: str = "cross") -> Raster:
    shrunk = grayscale_erode(marker, [1] * marker.dim, shape)
    return mask.with_rows(mask.zip(shrunk).withColumn("v", F.greatest("v0", "v1")))


def regional_extrema(r: Raster, maxima: bool = True, fully_connected: bool = False) -> Raster:
    """1 on flat zones without a higher (``maxima``) or lower neighbour."""
    from .labels import _components

    zones = _components(r, r.df, F.col("v") == F.col("w"), fully_connected, np.equal)
    shape = "box" if fully_connected else "cross"
    edge = (grayscale_dilate if maxima else grayscale_erode)(r, [1] * r.dim, shape)
    rows = zones.select(*r.keys, "v", "root").join(edge.df.withColumnRenamed("v", "e"), r.keys)
    top = rows.groupBy("root").agg(F.bool_and(F.col("e") == F.col("v")).alias("top"))
    return r.with_rows(rows.join(top, "root").withColumn("v", F.when(F.col("top"), 1).otherwise(0)), pixel="uint8")


def connected_opening(r: Raster, seed: Sequence[int], closing: bool = False) -> Raster:
    """What is connected to the seed at its own height (``closing``: depth)."""
    at = reduce(lambda a, b: a & b, [F.col(x) == i for x, i in zip(r.axes, seed)])
    ends = r.df.groupBy("image_id").agg((F.max("v") if closing else F.min("v")).alias("end"))
    marker = r.with_rows(r.df.join(ends, "image_id").withColumn("v", F.when(at, F.col("v")).otherwise(F.col("end"))))
    return reconstruction(marker, r, "erosion" if closing else "dilation")


def area_opening(r: Raster, area: float, use_spacing: bool = True, fully_connected: bool = False, closing: bool = False) -> Raster:
    """Peaks (``closing``: pits) smaller than ``area`` are levelled until they are as large.

    A round levels every too small regional extremum to its nearest neighbouring value.  It
    then holds at least one voxel more, so the rounds number at most the voxels of ``area``.
    A zone that fills its image stays.
    """
    from .labels import _components

    voxel = math.prod(r.geometry.spacing) if use_spacing else 1.0
    shape = element("box" if fully_connected else "cross", [1] * r.dim)
    value = F.col("v")
    while True:
        zones = _components(r, r.df, value == F.col("w"), fully_connected, np.equal).select(*r.keys, "v", "root")
        box = taps(r, [1] * r.dim, "null").df.select(*r.keys, _pick(value, shape).alias("near"))
        rows = zones.join(box, r.keys)
        ahead = F.exists("near", lambda x: x < value if closing else x > value)
        beside = F.filter("near", lambda x: x > value if closing else x < value)
        zone = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(ahead, F.lit(False))).alias("slope"), (F.min(F.array_min(beside)) if closing else F.max(F.array_max(beside))).alias("to"))
        small = staged(zone.where(~F.col("slope") & (F.col("n") * voxel < area) & F.col("to").isNotNull()).select("root", "to"))
        if small.isEmpty():
            return r
        r = r.with_rows(staged(rows.join(small, "root", "left").select(*r.keys, F.coalesce("to", "v").alias("v"))))


def area_closing(r: Raster, area: float, use_spacing: bool = True, fully_connected: bool = False) -> Raster:
    return area_opening(r, area, use_spacing, fully_connected, closing=True)


def simple_contour_extractor(r: Raster, radius: Sequence[int], foreground: int = 1, background: int = 0) -> Raster:
    """Foreground voxels with background in their box (edge repeated)."""
    n = len(element("box", radius))
    return _filter(r, radius, lambda w: F.when((F.element_at(w, n // 2 + 1) == foreground) & F.exists(w, lambda x: x == background), foreground).otherwise(background))


def binary_thinning(r: Raster) -> Raster:
    """Skeleton of a 2-D mask: rounds of two passes that peel boundary voxels whose removal keeps the
    topology (one 0-1 change around, 2 to 6 neighbours), until nothing changes."""
    plane_only(r, "binary_thinning")
    now = r.map(lambda v: F.when(v != 0, 1).otherwise(0), "uint8")
    order = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]  # clockwise from above
    while True:
        before = now
        for turn in (0, 1):
            box = taps(now, (1, 1), "constant", 0).df
            p = [F.element_at("v", (dy + 1) * 3 + dx + 2) for dx, dy in order]
            count = reduce(lambda a, b: a + b, p)
            changes = reduce(lambda a, b: a + b, [((p[k] == 0) & (p[(k + 1) % 8] == 1)).cast("int") for k in range(8)])
            up, right, down, left = p[0], p[2], p[4], p[6]
            free = ((up * right * down == 0) & (right * down * left == 0)) if turn == 0 else ((up * right * left == 0) & (up * down * left == 0))
            goes = (F.element_at("v", 5) == 1) & count.between(2, 6) & (changes == 1) & free
            now = now.with_rows(staged(box.select(*now.keys, F.when(goes, 0).otherwise(F.element_at("v", 5)).alias("v"))))
        if not before.zip(now).where("v0 <> v1").limit(1).count():
            return now
