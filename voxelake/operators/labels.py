"""Label images and label maps: components, per-label measures, overlap, voting, run-length maps."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..graph import connected_components, roots
from ..raster import AXES, PIXELS, Raster, grid
from ..staging import staged
from .pixelwise import label_overlay, label_to_rgb


def _number(rows: DataFrame, r: Raster, by: str) -> DataFrame:
    """Consecutive labels for each image in the order of each component's first raster position.

    ``rows`` has the keys and ``by``; the ranking runs over one row for each component.
    """
    first = rows.groupBy("image_id", by).agg(F.min(r.pos).alias("first"))
    ranked = first.withColumn("label", F.row_number().over(Window.partitionBy("image_id").orderBy("first")))
    return rows.join(ranked.select("image_id", by, "label"), ["image_id", by])


#: Voxels of a tile whose components one task finds at a time.
TILE_VOXELS = 1 << 18
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _offsets(dim: int, fully_connected: bool) -> list[tuple[int, ...]]:
    """The half of the neighbours that lies ahead, as steps along the axes."""
    ahead = [o for o in itertools.product((-1, 0, 1), repeat=dim) if o > (0,) * dim]
    return [o[::-1] for o in ahead if fully_connected or sum(map(abs, o)) == 1]


def _array(column: pa.ChunkedArray) -> np.ndarray:
    """Values as NumPy has them: integers stay integers, vectors become rows."""
    if pa.types.is_list(column.type):
        return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)
    if pa.types.is_decimal(column.type):
        return np.array(column.to_pylist(), object).astype(np.uint64)
    return column.to_numpy()


def _apart(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """abs(v - w), exact for integers of 64 bits."""
    if v.dtype.kind not in "iu":
        return np.abs(v - w)
    high, low = np.maximum(v, w), np.minimum(v, w)
    return high.astype(np.uint64) - low.astype(np.uint64)


def _tile_roots(axes: Sequence[str], size: Sequence[int], side: int, offsets: Sequence[Sequence[int]], alike: Alike | None):
    """For the voxels of one tile: the smallest raster position of each one's component."""

    def find(tile: pa.Table) -> pa.Table:
        at = [tile.column(a).to_numpy() for a in axes]
        near = [a % side for a in at]
        values = _array(tile.column("v")) if alike else None
        place = np.full([side + 2] * len(axes), -1, np.int64)
        place[tuple(a + 1 for a in near)] = np.arange(tile.num_rows)
        links = []
        for o in offsets:
            other = place[tuple(a + 1 + k for a, k in zip(near, o))]
            own = np.flatnonzero(other >= 0)
            other = other[own]
            if alike:
                joined = alike(values[own], values[other])
                own, other = own[joined], other[joined]
            links.append((own, other))
        pos = np.zeros(tile.num_rows, np.int64)
        for a, n in zip(reversed(at), reversed(size)):
            pos = pos * n + a
        order = np.argsort(pos)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        left, right = (rank[np.concatenate(x)] for x in zip(*links))
        ident = tile.column("image_id").to_numpy() * int(np.prod(size)) + pos
        return tile.append_column("run", pa.array(ident[order[roots(len(pos), left, right)[rank]]]))

    return find


def _components(r: Raster, inside: DataFrame, joins: Column, fully_connected: bool, alike: Alike | None = None) -> DataFrame:
    """Keys and ``root`` of voxels of ``inside``; neighbours are linked where ``joins`` holds
    between a voxel's ``v`` and its neighbour's ``w`` (``alike``: the same on arrays, None for
    a rule that always holds).

    Tiles find their own components, a bounded block of voxels at a time; only links across
    tile borders, between these components, go to the search over all.
    """
    side = max(2, round(TILE_VOXELS ** (1 / r.dim)))
    offsets = _offsets(r.dim, fully_connected)
    tile = [F.floor(F.col(a) / side).cast("int").alias(f"tile_{a}") for a in r.axes]
    rows = inside.select(*r.keys, "v")
    kinds = StructType([*rows.schema.fields, StructField("run", LongType())])
    rows = staged(rows.groupBy("image_id", *tile).applyInArrow(_tile_roots(r.axes, r.geometry.size, side, offsets, alike), kinds))
    if max(r.geometry.size) <= side:
        return rows.withColumn("root", F.col("run"))
    edges = []
    for o in offsets:
        step = dict(zip(r.axes, o))
        crosses = lambda sign: reduce(lambda a, b: a | b, [F.floor((F.col(a) + sign * k) / side) != F.floor(F.col(a) / side) for a, k in step.items() if k])  # noqa: B023, E731
        behind = rows.where(crosses(-1)).select("image_id", *[(F.col(a) - k).cast("int").alias(a) for a, k in step.items()], F.col("v").alias("w"), F.col("run").alias("other"))
        edges.append(rows.where(crosses(1)).join(behind, r.keys).where(joins).select(F.col("run").alias("u"), F.col("other").alias("v")))
    comps = connected_components(reduce(lambda a, b: a.union(b), edges).distinct())
    return rows.join(comps.withColumnRenamed("node", "run"), "run", "left").withColumn("root", F.coalesce("root", "run"))


def _labelled(r: Raster, rows: DataFrame, name: str = "root") -> Raster:
    found = _number(rows, r, name).select(*r.keys, "label")
    return r.with_rows(r.df.drop("v").join(found, r.keys, "left").withColumn("v", F.coalesce("label", F.lit(0))), pixel="uint32")


def connected_component(r: Raster, fully_connected: bool = False) -> Raster:
    """Components of the voxels that are not zero, numbered by first appearance in raster order."""
    return _labelled(r, _components(r, r.df.where("v <> 0"), F.lit(True), fully_connected))


def scalar_connected_component(r: Raster, distance: float = 0, fully_connected: bool = False) -> Raster:
    """Components of neighbours whose values differ by at most ``distance``."""
    wide = "decimal(38,0)" if r.pixel.integer else r.pixel.spark
    return _labelled(r, _components(r, r.df, F.abs(F.col("v").cast(wide) - F.col("w").cast(wide)) <= distance, fully_connected, lambda v, w: _apart(v, w) <= distance))


def vector_connected_component(r: Raster, distance: float = 1.0, fully_connected: bool = False) -> Raster:
    """Components of neighbours whose vectors (of length 1) have 1 - abs(dot) of at most ``distance``."""
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return _labelled(r, _components(r, r.df, 1 - F.abs(dot) <= distance, fully_connected, lambda v, w: 1 - np.abs((v * w).sum(-1)) <= distance))


def threshold_maximum_connected_components(r: Raster, minimum_size: int = 0, upper: float | None = None, inside: int = 1, outside: int = 0) -> tuple[Raster, float, int]:
    """The lower threshold, by bisection of the value range, at which most components of at least
    ``minimum_size`` voxels lie between it and ``upper``: mask, threshold, number of components."""
    low, high = r.df.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
    top = high if upper is None else upper
    half = (lambda a, b: a + int((b - a) / 2)) if r.pixel.integer else (lambda a, b: a + (b - a) / 2)

    def mask(threshold: float) -> Raster:
        return r.map(lambda v: F.when(v.between(threshold, top), inside).otherwise(outside), "uint8")

    def components(threshold: float) -> int:
        found = _components(r, mask(threshold).df.where(F.col("v") == inside), F.lit(True), False)
        return found.groupBy("root").count().where(F.col("count") >= minimum_size).count()

    middle = half(low, high)
    while high - low > (2 if r.pixel.integer else 1e-3 * max(1.0, abs(high))):
        left, right = half(low, middle), high - (half(middle, high) - middle)
        if components(left) > components(right):
            high, middle = middle, left
        else:
            low, middle = middle, right
    return mask(middle), middle, components(middle)


def relabel_component(labels: Raster, minimum_size: int = 0) -> Raster:
    """Labels by falling size, ties by rising label; smaller objects go to the background."""
    sizes = labels.df.where("v <> 0").groupBy("image_id", "v").count().where(F.col("count") >= minimum_size)
    new = sizes.withColumn("label", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("count"), "v"))).select("image_id", "v", "label")
    return labels.with_rows(labels.df.join(new, ["image_id", "v"], "left").withColumn("v", F.coalesce("label", F.lit(0))))


def threshold_components(r: Raster, lower: float, upper: float, inner_lower: float, inner_upper: float) -> Raster:
    """Double threshold: components of the wide range that hold a voxel of the narrow one."""
    wide = _components(r, r.df.where(F.col("v").between(lower, upper)), F.lit(True), False)
    hit = wide.where(F.col("v").between(inner_lower, inner_upper)).select("root").distinct()
    kept = wide.join(hit, "root", "left_semi").select(*r.keys, F.lit(1).alias("in"))
    return r.with_rows(r.df.drop("v").join(kept, r.keys, "left").withColumn("v", F.coalesce("in", F.lit(0))), pixel="uint8")


def connected_threshold(r: Raster, seeds: Sequence[Sequence[int]], lower: float, upper: float, fully_connected: bool = False) -> Raster:
    """Region growing: the voxels within range that are connected to a seed."""
    rows = _components(r, r.df.where(F.col("v").between(lower, upper)), F.lit(True), fully_connected)
    at = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(x) == i for x, i in zip(r.axes, s)]) for s in seeds])
    hit = rows.where(at).select("root").distinct()
    kept = rows.join(hit, "root", "left_semi").select(*r.keys, F.lit(1).alias("in"))
    return r.with_rows(r.df.drop("v").join(kept, r.keys, "left").withColumn("v", F.coalesce("in", F.lit(0))), pixel="uint8")


def label_statistics(r: Raster, labels: Raster) -> DataFrame:
    """One row for each image and label, 0 included: count, minimum, maximum, mean, variance, sigma,
    sum and the bounding box."""
    v = F.col("v0").cast("double")
    box = [f(a).alias(f"{n}_{a}") for a in r.axes for n, f in (("min", F.min), ("max", F.max))]
    variance = F.coalesce(F.when(F.count(v) > 1, F.var_samp(v)), F.lit(0.0))
    rows = r.zip(labels).groupBy("image_id", F.col("v1").alias("label")).agg(F.count(v).alias("count"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), variance.alias("variance"), F.sum(v).alias("sum"), *box)
    return rows.withColumn("sigma", F.sqrt(F.greatest("variance", F.lit(0.0))))


def label_shape_statistics(labels: Raster) -> DataFrame:
    """For each label but 0: voxels, physical size, centroid, bounding box, voxels on the grid's
    border, second central moments (physical) and the principal moments of 2-D objects."""
    g = labels.geometry
    point = {a: sum((F.col(b) * (g.direction[i][j] * g.spacing[j]) for j, b in enumerate(labels.axes)), F.lit(g.origin[i])) for i, a in enumerate(labels.axes)}
    rows = labels.df.where("v <> 0").select("image_id", F.col("v").alias("label"), *labels.axes, *[c.alias(f"p_{a}") for a, c in point.items()])
    edge = reduce(lambda a, b: a | b, [(F.col(a) == 0) | (F.col(a) == labels.size(a) - 1) for a in labels.axes])
    aggs = [F.count(F.lit(1)).alias("voxels"), F.count_if(edge).alias("border_voxels")]
    aggs += [F.avg(f"p_{a}").alias(f"centroid_{a}") for a in labels.axes]
    aggs += [f(a).alias(f"{n}_{a}") for a in labels.axes for n, f in (("min", F.min), ("max", F.max))]
    pairs = list(itertools.combinations_with_replacement(labels.axes, 2))
    aggs += [F.covar_pop(f"p_{a}", f"p_{b}").alias(f"moment_{a}{b}") for a, b in pairs]
    out = rows.groupBy("image_id", "label").agg(*aggs)
    volume = 1.0
    for s in g.spacing:
        volume *= s
    out = out.withColumn("physical_size", F.col("voxels") * volume)
    if labels.dim == 2:
        half, diff = (F.col("moment_xx") + F.col("moment_yy")) / 2, (F.col("moment_xx") - F.col("moment_yy")) / 2
        root = F.sqrt(diff * diff + F.col("moment_xy") * F.col("moment_xy"))
        out = out.withColumn("principal_low", half - root).withColumn("principal_high", half + root)
    return out


def label_intensity_statistics(r: Raster, labels: Raster) -> DataFrame:
    """For each label but 0: sum, mean, skewness, kurtosis and the intensity-weighted centre."""
    v = F.col("v0").cast("double")
    centre = [(F.sum(v * F.col(a)) / F.sum(v)).alias(f"weighted_{a}") for a in r.axes]
    return r.zip(labels).where("v1 <> 0").groupBy("image_id", F.col("v1").alias("label")).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.max_by(r.pos, v).alias("at_maximum"), *centre)


def label_overlap(source: Raster, target: Raster) -> DataFrame:
    """Overlap measures for each label: Jaccard, Dice, volume similarity, false negatives and positives."""
    pairs = source.zip(target).groupBy("image_id", "v0", "v1").count()
    part = lambda c, name: pairs.groupBy("image_id", F.col(c).alias("label")).agg(F.sum("count").alias(name))
    both = pairs.where("v0 = v1").select("image_id", F.col("v0").alias("label"), F.col("count").alias("both"))
    rows = part("v0", "source").join(part("v1", "target"), ["image_id", "label"], "full").join(both, ["image_id", "label"], "left").fillna(0, ["source", "target", "both"])
    s, t, b = F.col("source"), F.col("target"), F.col("both")
    top = F.lit(1.7976931348623157e308)
    over = lambda x, y: F.when(y == 0, top).otherwise(x / F.when(y == 0, F.lit(1)).otherwise(y))
    return rows.where("label <> 0").select("image_id", "label", over(b, s + t - b).alias("jaccard"), over(2 * b, s + t).alias("dice"), over(2 * (s - t), s + t).alias("volume_similarity"), over(t - b, t).alias("false_negative"), over(s - b, s).alias("false_positive"))


def similarity_index(a: Raster, b: Raster) -> DataFrame:
    both = F.count_if((F.col("v0") != 0) & (F.col("v1") != 0))
    return a.zip(b).groupBy("image_id").agg((2 * both / F.greatest(F.count_if(F.col("v0") != 0) + F.count_if(F.col("v1") != 0), F.lit(1))).alias("similarity"))


def label_voting(rasters: Sequence[Raster], undecided: int | None = None) -> Raster:
    """The label that most rasters give a voxel; ``undecided`` (default: largest label + 1) in a tie."""
    first = rasters[0]
    votes = reduce(lambda a, b: a.unionByName(b), [o.df for o in rasters]).groupBy(*first.keys, "v").count()
    top = votes.groupBy(*first.keys).agg(F.sort_array(F.collect_list(F.struct("count", "v")), asc=False).alias("t"))
    if undecided is None:
        tops = reduce(lambda a, b: a.unionByName(b), [o.df for o in rasters]).groupBy("image_id").agg((F.max("v") + 1).alias("undecided"))
        top = top.join(tops, "image_id")
        undecided = F.col("undecided")
    tie = (F.size("t") > 1) & (F.col("t")[0]["count"] == F.try_element_at("t", F.lit(2))["count"])
    return first.with_rows(top.withColumn("v", F.when(tie, undecided).otherwise(F.col("t")[0]["v"])))


def staple(rasters: Sequence[Raster], foreground: int = 1, rounds: int = 100) -> tuple[Raster, list[tuple[float, float]]]:
    """Expectation maximisation over raters: probability of foreground, and each rater's
    sensitivity and specificity.  Rounds run over the counts of rater patterns (2**raters)."""
    first, n = rasters[0], len(rasters)
    bits = [(F.col(f"v{k}") == foreground).cast("int") for k in range(n)]
    rows = first.zip(*rasters[1:]).select(*first.keys, F.array(*bits).alias("d"))
    patterns = [(tuple(x.d), x["count"]) for x in rows.groupBy("d").count().collect()]
    total = sum(c for _, c in patterns)
    prior = sum(sum(d) * c for d, c in patterns) / (n * total)
    p = q = [0.99999] * n
    w: dict = {}
    for _ in range(rounds):
        for d, _c in patterns:
            a, b = prior, 1 - prior
            for j, x in enumerate(d):
                a *= p[j] if x else 1 - p[j]
                b *= 1 - q[j] if x else q[j]
            w[d] = a / (a + b) if a + b else 0.0
        inside, outside = sum(w[d] * c for d, c in patterns), sum((1 - w[d]) * c for d, c in patterns)
        new_p = [sum(w[d] * c for d, c in patterns if d[j]) / inside if inside else 0.0 for j in range(n)]
        new_q = [sum((1 - w[d]) * c for d, c in patterns if not d[j]) / outside if outside else 0.0 for j in range(n)]
        done = max(abs(x - y) for x, y in zip(p + q, new_p + new_q)) < 1e-14
        p, q = new_p, new_q
        if done:
            break
    value = reduce(lambda e, item: F.when(F.col("d") == F.array(*[F.lit(x) for x in item[0]]), item[1]).otherwise(e), w.items(), F.lit(0.0))
    return Raster(rows.select(*first.keys, value.alias("v")), first.geometry, PIXELS["float64"]), list(zip(p, q))


# Run-length label maps: image_id, label, y (and z), x, len


def to_label_map(labels: Raster, background: int = 0) -> DataFrame:
    """Runs along x of equal labels: image_id, label, the other axes, x, len."""
    rest = list(labels.axes[1:])
    rows = labels.df.where(F.col("v") != background)
    island = F.col("x") - F.row_number().over(Window.partitionBy("image_id", *rest, "v").orderBy("x"))
    return rows.withColumn("g", island).groupBy("image_id", F.col("v").alias("label"), *rest, "g").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("len")).drop("g")


def from_label_map(runs: DataFrame, like: Raster, background: int = 0) -> Raster:
    """The label image of runs; where objects overlap the smallest label wins."""
    rest = list(like.axes[1:])
    voxels = runs.select("image_id", "label", *rest, F.explode(F.sequence(F.col("x"), (F.col("x") + F.col("len") - 1).cast("int"))).alias("x")).groupBy("image_id", "x", *rest).agg(F.min("label").alias("v"))
    return like.with_rows(grid(like.df, like.geometry).join(voxels, like.keys, "left").withColumn("v", F.coalesce("v", F.lit(background))), pixel="uint32")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs of one label that touch or overlap become one."""
    rest = [a for a in AXES[1:] if a in runs.columns]
    line = Window.partitionBy("image_id", "label", *rest).orderBy("x", "len")
    reach = F.max(F.col("x") + F.col("len")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("x") > reach).cast("int"), F.lit(1))
    marked = runs.withColumn("new", new).withColumn("g", F.sum("new").over(line))
    return marked.groupBy("image_id", "label", *rest, "g").agg(F.min("x").alias("x"), (F.max(F.col("x") + F.col("len")) - F.min("x")).alias("len")).drop("g")


def change_label_map(runs: DataFrame, changes: dict[int, int]) -> DataFrame:
    label = reduce(lambda e, kv: F.when(F.col("label") == kv[0], kv[1]).otherwise(e), changes.items(), F.col("label"))
    return merge_runs(runs.withColumn("label", label))


def aggregate_label_map(runs: DataFrame) -> DataFrame:
    """All objects of an image become the one of the smallest label."""
    low = runs.groupBy("image_id").agg(F.min("label").alias("low"))
    return merge_runs(runs.join(low, "image_id").withColumn("label", F.col("low")).drop("low"))


def relabel_label_map(runs: DataFrame, background: int = 0) -> DataFrame:
    """Consecutive labels from 0 in the order of the old ones, without the background's value."""
    names = runs.select("image_id", "label").distinct()
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("label")) - 1
    new = names.withColumn("k", rank).withColumn("new", F.when(F.col("k") >= background, F.col("k") + 1).otherwise(F.col("k")))
    return runs.join(new, ["image_id", "label"]).withColumn("label", F.col("new")).drop("k", "new")


def label_map_to_rgb(runs: DataFrame, like: Raster, palette: list[tuple[int, int, int]]) -> Raster:
    """The palette's colour of each object, black elsewhere."""
    return label_to_rgb(from_label_map(runs, like), palette)


def label_map_overlay(runs: DataFrame, feature: Raster, palette: list[tuple[int, int, int]], opacity: float = 0.5) -> Raster:
    """Objects blended over the feature."""
    return label_overlay(feature, from_label_map(runs, feature), palette, opacity)


def label_map_contour_overlay(runs: DataFrame, feature: Raster, palette: list[tuple[int, int, int]], opacity: float = 0.5, fully_connected: bool = False) -> Raster:
    """Only the objects' contours blended over the feature."""
    from .morphology import label_contour

    return label_overlay(feature, label_contour(from_label_map(runs, feature), fully_connected), palette, opacity)


def label_map_mask(runs: DataFrame, feature: Raster, label: int, negated: bool = False, background: float = 0) -> Raster:
    """The feature inside one object (``negated``: outside it)."""
    inside = from_label_map(runs.where(F.col("label") == label), feature)
    rows = feature.zip(inside)
    keep = (F.col("v1") != label) if negated else (F.col("v1") == label)
    return feature.with_rows(rows.withColumn("v", F.when(keep, F.col("v0")).otherwise(background)))


def binary_image_to_label_map(r: Raster, foreground: float = 1, fully_connected: bool = False) -> DataFrame:
    """Runs of the components of one value."""
    return to_label_map(connected_component(r.map(lambda v: F.when(v == foreground, 1).otherwise(0), "uint8"), fully_connected))


def label_map_to_binary(runs: DataFrame, like: Raster, foreground: int = 1, background: int = 0) -> Raster:
    """Foreground inside any object."""
    inside = from_label_map(runs.withColumn("label", F.lit(1)), like)
    return like.with_rows(inside.df.withColumn("v", F.when(F.col("v") == 1, foreground).otherwise(background)), pixel="uint8")


def label_unique_label_map(runs: DataFrame, reverse: bool = False) -> DataFrame:
    """Overlaps go to the larger label (``reverse``: the smaller); objects without voxels vanish.

    Where any runs overlap is found on their ends, so voxels are never listed: a line is cut
    at all ends, and each piece takes the winning label of the runs that hold it.
    """
    rest = [a for a in AXES[1:] if a in runs.columns]
    line = ["image_id", *rest]
    ends = runs.select(*line, F.col("x").alias("at")).union(runs.select(*line, (F.col("x") + F.col("len")).alias("at"))).distinct()
    pieces = ends.withColumn("stop", F.lead("at").over(Window.partitionBy(*line).orderBy("at"))).where("stop is not null")
    held = pieces.join(runs, line).where((F.col("x") <= F.col("at")) & (F.col("at") < F.col("x") + F.col("len")))
    won = held.groupBy(*line, "at", "stop").agg((F.min if reverse else F.max)("label").alias("label"))
    return merge_runs(won.select("image_id", "label", *rest, F.col("at").alias("x"), (F.col("stop") - F.col("at")).alias("len")))


def merge_label_maps(maps: Sequence[DataFrame], method: str = "keep") -> DataFrame:
    """Several maps as one.  ``keep``: a label that is taken gets the next free number after the
    largest; ``aggregate``: objects of one label become one; ``pack``: all objects are numbered
    anew from 1, map by map; ``strict``: a label in two maps of an image is an error."""
    both = reduce(lambda a, b: a.unionByName(b), [m.withColumn("map", F.lit(k)) for k, m in enumerate(maps)])
    if method == "aggregate":
        return merge_runs(both.drop("map"))
    names = both.select("image_id", "map", "label").distinct()
    first = names.withColumn("nth", F.row_number().over(Window.partitionBy("image_id", "label").orderBy("map")))
    in_order = Window.partitionBy("image_id").orderBy("map", "label")
    if method == "strict":
        taken = F.raise_error(F.concat(F.lit("two maps hold label "), F.col("label").cast("string"))).cast("long")
        new = first.withColumn("new", F.when(F.col("nth") == 1, F.col("label")).otherwise(taken))
    elif method == "pack":
        new = first.withColumn("new", F.row_number().over(in_order))
    elif method == "keep":
        late = F.sum((F.col("nth") > 1).cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
        new = first.withColumn("new", F.when(F.col("nth") == 1, F.col("label")).otherwise(F.max("label").over(Window.partitionBy("image_id")) + late))
    else:
        raise ValueError(f"no way to merge called {method}")
    return both.join(new.select("image_id", "map", "label", "new"), ["image_id", "map", "label"]).withColumn("label", F.col("new")).drop("map", "new")


def _ellipsoid(r: Raster, radius: Sequence[float], use_spacing: bool) -> list[tuple[tuple[int, ...], float]]:
    """Offsets inside the open ellipsoid and their scaled squared distance; without spacing the
    ellipsoid is a little larger, so that whole radii are inside."""
    scale = [(k * k / (s * s) if use_spacing else k * k + 2) if k else 0.0 for k, s in zip(radius, r.geometry.spacing)]
    reach = [math.floor(math.sqrt(x)) if x else 0 for x in scale]
    out = []
    for o in itertools.product(*[range(-k, k + 1) for k in reach]):
        w = sum(i * i / x for i, x in zip(o, scale) if x)
        if w < 1:
            out.append((o, w))
    return out


def label_set_dilate(labels: Raster, radius: Sequence[float], use_spacing: bool = True) -> Raster:
    """Every label grows by an ellipsoid into the background; the nearest label wins, the smaller of
    equally near ones."""
    reach = F.array(*[F.struct(*[F.lit(i).alias(f"d{a}") for a, i in zip(labels.axes, o)], F.lit(w).alias("w")) for o, w in _ellipsoid(labels, radius, use_spacing)])
    grown = labels.df.where("v <> 0").select("image_id", *labels.axes, F.col("v").alias("label"), F.explode(reach).alias("o"))
    grown = grown.select("image_id", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in labels.axes], F.struct(F.round("o.w", 12).alias("w"), "label").alias("near"))
    best = grown.groupBy("image_id", *labels.axes).agg(F.min("near").alias("near"))
    return labels.with_rows(labels.df.join(best, labels.keys, "left").withColumn("v", F.when(F.col("v") != 0, F.col("v")).otherwise(F.coalesce("near.label", F.lit(0)))))


def label_set_erode(labels: Raster, radius: Sequence[float], use_spacing: bool = True) -> Raster:
    """Every label loses the voxels that have another value inside their ellipsoid; the grid's border
    takes nothing away."""
    reach = F.array(*[F.struct(*[F.lit(i).alias(f"d{a}") for a, i in zip(labels.axes, o)]) for o, _ in _ellipsoid(labels, radius, use_spacing)])
    seen = labels.df.select("image_id", *labels.axes, "v", F.explode(reach).alias("o"))
    seen = seen.select("image_id", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in labels.axes], "v")
    span = seen.groupBy("image_id", *labels.axes).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return labels.with_rows(labels.df.join(span, labels.keys).withColumn("v", F.when(F.col("low") == F.col("high"), F.col("v")).otherwise(0)))
