"""Contours of plane images as polylines: marching squares, and list ranking of their segments.

A segment crosses one square of four voxels; it ends where the next one begins, at the same edge
of the grid.  Pointer doubling over this link table finds for every segment the end of its chain
and its distance to it, in as many joins as the longest chain has binary digits.  Closed
chains are cut behind their last segment in raster order and ranked again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..raster import Raster
from ..staging import staged

#: For each square (top left, top right, bottom left, bottom right above the value: 1, 2, 4, 8) the
#: sides that segments come from and go to, the lower side on their left; other ways of saddles.
SIDES = {
    1: ["tl"], 2: ["rt"], 3: ["rl"], 4: ["lb"], 5: ["tb"], 6: ["rt", "lb"], 7: ["rb"], 8: ["br"], 9: ["tl", "br"], 10: ["bt"], 11: ["bl"], 12: ["lr"], 13: ["tr"], 14: ["lt"],
}
JOINED = {6: ["lt", "rb"], 9: ["tr", "bl"]}


def _segments(r: Raster, value: float, connect_high: bool) -> DataFrame:
    """image_id, id (rising in raster order of the squares), the edges and points at both ends."""
    level = F.lit(float(value)) if not r.pixel.integer else r.pixel.saturate(F.lit(float(value)))
    v = lambda k: F.col(f"v{k}").cast("double")
    right = F.lead(F.struct("x", "v")).over(Window.partitionBy("image_id", "y").orderBy("x"))
    rows = r.df.withColumn("next", right).where("next.x = x + 1").select("image_id", "x", "y", F.col("v").alias("v0"), F.col("next.v").alias("v1"))
    below = F.lead(F.struct("y", "v0", "v1")).over(Window.partitionBy("image_id", "x").orderBy("y"))
    rows = rows.withColumn("next", below).where("next.y = y + 1").select("image_id", "x", "y", "v0", "v1", F.col("next.v0").alias("v2"), F.col("next.v1").alias("v3"))
    rows = rows.withColumn("square", sum(F.when(F.col(f"v{k}") > level, 2**k).otherwise(0) for k in range(4))).where("square between 1 and 14")
    part = lambda a, b: (level.cast("double") - v(a)) / (v(b) - v(a))
    pos = F.col("x") + F.col("y").cast("long") * r.size("x")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")

    def crossing(side: str) -> list[Column]:
        edge, px, py = {
            "t": (2 * pos, x + part(0, 1), y), "b": (2 * (pos + r.size("x")), x + part(2, 3), y + 1),
            "l": (2 * pos + 1, x, y + part(0, 2)), "r": (2 * (pos + 1) + 1, x + 1, y + part(1, 3)),
        }[side]
        return [edge.alias("edge"), px.alias("x"), py.alias("y")]

    segment = lambda k, way: F.struct((2 * pos + k).alias("id"), F.struct(*crossing(way[0])).alias("a"), F.struct(*crossing(way[1])).alias("b"))
    ways = None
    for square, plain in SIDES.items():
        these = F.array(*[segment(k, w) for k, w in enumerate(JOINED[square] if connect_high and square in JOINED else plain)])
        ways = F.when(F.col("square") == square, these) if ways is None else ways.when(F.col("square") == square, these)
    return rows.select("image_id", F.explode(ways).alias("s")).select("image_id", "s.*")


def _ranked(links: DataFrame, rounds: int) -> DataFrame:
    """``links`` (image_id, id, next, w, top) with what lies between each row and the end of its chain:
    ``last``, the sum of ``w``, the largest ``top``; ``next`` stays set in chains without an end."""
    now = links.select("image_id", "id", "next", F.col("id").alias("last"), "w", "top")
    for _ in range(rounds):
        ahead = now.select("image_id", F.col("id").alias("next"), F.col("next").alias("n2"), F.col("last").alias("l2"), F.col("w").alias("w2"), F.col("top").alias("t2"))
        joined = now.join(ahead, ["image_id", "next"], "left")
        now = staged(joined.select("image_id", "id", F.col("n2").alias("next"), F.coalesce("l2", "last").alias("last"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.greatest("top", "t2").alias("top")))
        if now.where("next is not null").isEmpty():
            break
    return now


def contour_lines(r: Raster, value: float, connect_high: bool = False, reverse: bool = False) -> DataFrame:
    """image_id, contour, position, x, y: the points of each contour in order, in (continuous) voxels.

    Above is what is greater than ``value`` (made a value of the pixel type); it lies on the right of
    a line that goes on along its positions, on the left with ``reverse``.  At saddles the low voxels
    are joined, with ``connect_high`` the high ones.  Contours are numbered in raster order of the
    first square that each crosses; a closed one begins and ends where its last segment in that
    order ends, an open one at the border.  Where a line runs through a voxel that has the value,
    its repeated points are one; lines that are one point are left out.
    """
    if r.dim != 2:
        raise ValueError("contour lines take plane images")
    segments = staged(_segments(r, value, connect_high))
    count = segments.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, math.ceil(math.log2(count + 1)) + 1)
    moved = ((F.col("a.x") != F.col("b.x")) | (F.col("a.y") != F.col("b.y"))).cast("long")
    begins = segments.select("image_id", F.col("a.edge").alias("edge"), F.col("id").alias("next"))
    ends = segments.select("image_id", "id", F.col("b.edge").alias("edge"), moved.alias("w"))
    links = staged(ends.join(begins, ["image_id", "edge"], "left").select("image_id", "id", "next", "w", F.when(F.col("w") > 0, F.col("id")).otherwise(F.lit(-1)).alias("top")))
    first = _ranked(links, rounds)
    ring = first.where("next is not null").select("image_id", "id", F.col("top").alias("cut"))
    again = staged(links.join(ring, ["image_id", "id"]).select("image_id", "id", F.when(F.col("id") != F.col("cut"), F.col("next")).alias("next"), "w", "top"))
    chains = first.where("next is null")
    if not again.isEmpty():
        chains = chains.unionByName(_ranked(again, rounds).where("next is null"))
    ranked = staged(chains.select("image_id", "id", "last", F.col("w").alias("left")).join(segments, ["image_id", "id"]).withColumn("w", moved))
    whole = ranked.where("w > 0").groupBy("image_id", "last").agg(F.sum("w").alias("length"), F.min("id").alias("first"), F.max_by("b", F.struct(-F.col("left"))).alias("end"))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("first")) - 1
    whole = staged(whole.withColumn("contour", number.cast("long")))
    starts = ranked.where("w > 0").join(whole, ["image_id", "last"]).select("image_id", "contour", "length", (F.col("length") - F.col("left")).alias("position"), "a.x", "a.y")
    points = starts.unionByName(whole.select("image_id", "contour", "length", F.col("length").alias("position"), "end.x", "end.y"))
    place = F.col("length") - F.col("position") if reverse else F.col("position")
    return points.select("image_id", "contour", place.alias("position"), "x", "y")
