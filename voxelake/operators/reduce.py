"""Reductions: statistics, projections, remaps by statistics, histograms and their thresholds.

Statistics of an image are one aggregation that combines before its shuffle; a remap joins
the single row per image back (a side whose size is one row per image).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..raster import PIXELS, Geometry, Raster
from ..staging import staged


def statistics(r: Raster) -> DataFrame:
    """image_id, minimum, maximum, mean, variance, sigma, sum, count (variance of one voxel: 0)."""
    v = F.col("v").cast("double")
    return r.df.groupBy("image_id").agg(F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.coalesce(F.when(F.count(v) > 1, F.var_samp(v)), F.lit(0.0)).alias("variance"), F.coalesce(F.when(F.count(v) > 1, F.stddev_samp(v)), F.lit(0.0)).alias("sigma"), F.sum(v).alias("sum"), F.count(v).alias("count"))


def minimum_maximum(r: Raster) -> DataFrame:
    return r.df.groupBy("image_id").agg(F.min("v").alias("minimum"), F.max("v").alias("maximum"))


def with_statistics(r: Raster, value: Callable[[Column], Column], pixel: str | None = None) -> Raster:
    """A remap that may use the columns of ``statistics``."""
    p = PIXELS[pixel] if pixel else r.pixel
    rows = r.df.join(statistics(r), "image_id")
    return Raster(rows.select(*r.keys, p.saturate(value(F.col("v").cast("double"))).alias("v")), r.geometry, p)


def rescale_intensity(r: Raster, low: float = 0, high: float = 255) -> Raster:
    """Linear remap of the image's [min, max] onto [low, high]; a constant image is an error."""
    span = F.col("maximum") - F.col("minimum")
    checked = F.when(span == 0, F.raise_error(F.lit("a constant image cannot be rescaled")).cast("double")).otherwise(span)
    return with_statistics(r, lambda v: (v - F.col("minimum")) * ((high - low) / checked) + low)


def normalize(r: Raster) -> Raster:
    return with_statistics(r, lambda v: (v - F.col("mean")) / F.col("sigma"), "float64")


def normalize_to_constant(r: Raster, constant: float = 1) -> Raster:
    return with_statistics(r, lambda v: v / (F.col("sum") / F.lit(float(constant))), "float64")


def shift_scale_counts(r: Raster, shift: float, scale: float) -> DataFrame:
    """How many voxels leave the pixel type's range under (v + shift) * scale."""
    v = (F.col("v").cast("double") + shift) * scale
    return r.df.groupBy("image_id").agg(F.count_if(v < float(r.pixel.low)).alias("underflow"), F.count_if(v > float(r.pixel.high)).alias("overflow"))


#: Reductions of a line of voxels.
PROJECT: dict[str, Callable[[], Column]] = {
    "mean": lambda: F.avg(F.col("v").cast("double")),
    "sum": lambda: F.sum(F.col("v").cast("double")),
    "maximum": lambda: F.max("v"),
    "minimum": lambda: F.min("v"),
    "median": lambda: F.element_at(F.sort_array(F.collect_list("v")), (F.floor(F.count("v") / 2) + 1).cast("int")),
    "standard_deviation": lambda: F.coalesce(F.when(F.count("v") > 1, F.stddev_samp(F.col("v").cast("double"))), F.lit(0.0)),
}


def _drop_axis(r: Raster, axis: str, rows: DataFrame, pixel: str | None) -> Raster:
    """The projected grid: the axis stays with one voxel."""
    size = tuple(1 if a == axis else n for a, n in zip(r.axes, r.geometry.size))
    g = Geometry(size, r.geometry.spacing, r.geometry.origin, r.geometry.direction)
    return r.with_rows(rows.withColumn(axis, F.lit(0)), g, pixel)


def projection(r: Raster, axis: str, name: str) -> Raster:
    """One of PROJECT along an axis; mean, sum and deviation are real."""
    rows = r.df.groupBy("image_id", *[a for a in r.axes if a != axis]).agg(PROJECT[name]().alias("v"))
    return _drop_axis(r, axis, rows, "float64" if name in ("mean", "sum", "standard_deviation") else None)


def binary_projection(r: Raster, axis: str, foreground: float = 1, background: float = 0) -> Raster:
    rows = r.df.groupBy("image_id", *[a for a in r.axes if a != axis]).agg(F.when(F.bool_or(F.col("v") == foreground), foreground).otherwise(background).alias("v"))
    return _drop_axis(r, axis, rows, None)


def binary_threshold_projection(r: Raster, axis: str, threshold: float, foreground: int = 1, background: int = 0) -> Raster:
    rows = r.df.groupBy("image_id", *[a for a in r.axes if a != axis]).agg(F.when(F.bool_or(F.col("v") >= threshold), foreground).otherwise(background).alias("v"))
    return _drop_axis(r, axis, rows, "uint8")


# Histograms


def histogram_range(r: Raster, bins: int) -> DataFrame:
    """image_id, lower, upper of the histogram: the type's range for 8-bit pixels, else the data's
    range and a margin of a hundredth of a bin."""
    if r.pixel.name in ("uint8", "int8"):
        return r.df.select("image_id").distinct().withColumn("lower", F.lit(r.pixel.low - 0.5)).withColumn("upper", F.lit(r.pixel.high + 0.5))
    v = F.col("v").cast("double")
    return r.df.groupBy("image_id").agg(F.min(v).alias("lower"), (F.max(v) + (F.max(v) - F.min(v)) / bins / 100).alias("upper"))


def histogram(r: Raster, bins: int = 256) -> DataFrame:
    """image_id, bin, lower_edge, upper_edge, count for every bin, empty ones too."""
    span = histogram_range(r, bins)
    width = (F.col("upper") - F.col("lower")) / bins
    near = F.floor((F.col("v").cast("double") - F.col("lower")) / F.when(width == 0, F.lit(1.0)).otherwise(width)).cast("int")
    edge = lambda k: F.col("lower") + k * width
    placed = F.when(F.col("v") >= edge(near + 1), near + 1).when(F.col("v") < edge(near), near - 1).otherwise(near)
    number = F.when(width == 0, bins - 1).otherwise(F.least(F.greatest(placed, F.lit(0)), F.lit(bins - 1)))
    counts = r.df.join(span, "image_id").groupBy("image_id", number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counts, ["image_id", "bin"], "left")
    upper = F.when(F.col("bin") == bins - 1, F.col("upper")).otherwise(edge(F.col("bin") + 1))
    return out.select("image_id", "bin", edge(F.col("bin")).alias("lower_edge"), upper.alias("upper_edge"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


Bins = tuple[list[float], list[float], list[int]]


def _moments(b: Bins) -> tuple[list[float], float]:
    mid = [(lo + hi) / 2 for lo, hi in zip(b[0], b[1])]
    return mid, float(sum(b[2]))


def _otsu_cuts(b: Bins, cuts: int) -> list[int]:
    """Last bins of all classes but the last, with the greatest between-class variance."""
    mid, total = _moments(b)
    n = len(mid)
    weight, moment = [0.0], [0.0]
    for f, m in zip(b[2], mid):
        weight.append(weight[-1] + f)
        moment.append(moment[-1] + f * m)

    def gain(i: int, j: int) -> float:
        w = weight[j] - weight[i]
        return (moment[j] - moment[i]) ** 2 / w / total if w else 0.0

    best = [[gain(0, j) for j in range(n + 1)]]
    back: list[list[int]] = []
    for _ in range(cuts):
        row, origin = [0.0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            top = -1.0
            for i in range(1, j):
                g = best[-1][i] + gain(i, j)
                if g > top * (1 + 4e-16) or top < 0:
                    top, origin[j] = g, i
            row[j] = max(top, 0.0)
        best.append(row)
        back.append(origin)
    ends, j = [], n
    for origin in reversed(back):
        j = origin[j]
        ends.append(j - 1)
    return ends[::-1]


def _otsu(b: Bins) -> float:
    return b[1][_otsu_cuts(b, 1)[0]]


def _isodata(b: Bins) -> float:
    mid, total = _moments(b)
    for k, f in enumerate(b[2]):
        below, above = sum(b[2][: k + 1]), sum(b[2][k + 1 :])
        if f and below and above:
            mean = (sum(x * m for x, m in zip(b[2][: k + 1], mid)) / below + sum(x * m for x, m in zip(b[2][k + 1 :], mid[k + 1 :])) / above) / 2
            if mid[k] >= mean:
                return mid[k]
    return sum(x * m for x, m in zip(b[2], mid)) / total


def _entropies(b: Bins) -> tuple[list[float], list[float]]:
    total = float(sum(b[2]))
    p = [f / total for f in b[2]]
    below, s = [], 0.0
    for x in p:
        s += x
        below.append(s)
    return p, below


def _best(score: Callable[[int], float | None], n: int, least: float = 0.0) -> int:
    at, top = 0, None
    for k in range(n):
        s = score(k)
        if s is not None and (top is None or s > top + least):
            at, top = k, s
    return at


def _maximum_entropy(b: Bins) -> float:
    p, below = _entropies(b)

    def score(k: int) -> float | None:
        lo, hi = below[k], 1 - below[k]
        if lo <= 0 or hi <= 1e-12:
            return None
        return -sum(x / lo * math.log(x / lo) for x in p[: k + 1] if x) - sum(x / hi * math.log(x / hi) for x in p[k + 1 :] if x)

    return _moments(b)[0][_best(score, len(p), 1e-5)]


def _shanbhag(b: Bins) -> float:
    p, below = _entropies(b)

    def score(k: int) -> float | None:
        lo, hi = below[k], 1 - below[k]
        if lo <= 0 or hi <= 1e-12:
            return None
        back = sum(-x * math.log(max(1 - 0.5 * below[i - 1] / lo if i else 1.0, 1e-300)) for i, x in enumerate(p[: k + 1])) * 0.5 / lo
        fore = sum(-x * math.log(max(1 - 0.5 * (1 - below[k + 1 + i]) / hi, 1e-300)) for i, x in enumerate(p[k + 1 :])) * 0.5 / hi
        return -abs(back - fore)

    return _moments(b)[0][_best(score, len(p))]


def _yen(b: Bins) -> float:
    p, below = _entropies(b)
    squares = [x * x for x in p]

    def score(k: int) -> float:
        lo, hi = sum(squares[: k + 1]), sum(squares[k + 1 :])
        mass = below[k] * (1 - below[k])
        return -(math.log(lo * hi) if lo * hi > 0 else 0.0) + 2 * (math.log(mass) if mass > 0 else 0.0)

    return _moments(b)[0][_best(score, len(p))]


def _moments_threshold(b: Bins) -> float:
    mid, _ = _moments(b)
    p, below = _entropies(b)
    m1, m2, m3 = (sum(x * m**k for x, m in zip(p, mid)) for k in (1, 2, 3))
    cd = m2 - m1 * m1
    c0, c1 = (-m2 * m2 + m1 * m3) / cd, (-m3 + m2 * m1) / cd
    root = math.sqrt(max(c1 * c1 - 4 * c0, 0))
    z0, z1 = 0.5 * (-c1 - root), 0.5 * (-c1 + root)
    p0 = (z1 - m1) / (z1 - z0)
    return mid[next((k for k, s in enumerate(below) if s > p0), len(mid) - 1)]


def _intermodes(b: Bins) -> float:
    """The middle between two peaks, after as few of at most 1,000 smoothings as leave two.  A
    histogram that then has another number of them, like that of one value, is an error."""
    h = [float(x) for x in b[2]]
    if len(h) == 1:
        return _moments(b)[0][0]
    peaks = lambda: [k for k in range(1, len(h) - 1) if h[k - 1] < h[k] > h[k + 1]]
    for _ in range(1001):
        if len(peaks()) == 2:
            return _moments(b)[0][sum(peaks()) // 2]
        h = [((h[k - 1] if k else 0) + h[k] + (h[k + 1] if k + 1 < len(h) else 0)) / 3 for k in range(len(h))]
    raise ValueError("the histogram does not become bimodal")


def _triangle(b: Bins) -> float:
    mid, total = _moments(b)
    f = b[2]
    peak = max(range(len(f)), key=lambda k: (f[k], -k))
    run, low, high = 0, 0, len(f) - 1
    for k, x in enumerate(f):
        if run + x >= 0.01 * total:
            low = k
            break
        run += x
    run = 0
    for k in range(len(f) - 1, -1, -1):
        if run + f[k] >= 0.01 * total:
            high = k
            break
        run += f[k]
    side = range(low, peak + 1) if peak - low >= high - peak else range(peak, high + 1)
    start, stop = side[0], side[-1]
    slope = (f[stop] - f[start]) / max(stop - start, 1)
    at = max(side, key=lambda k: (f[start] + slope * (k - start) - f[k], -k))
    return mid[min(at + 1, len(mid) - 1)]


def _bin(b: Bins, value: float) -> int:
    """The bin that holds a value; values beyond the ends belong to the first or the last bin."""
    if value < b[0][0]:
        return 0
    return len(b[0]) - 1 if value >= b[1][-1] else bisect_right(b[0], value) - 1


def _li(b: Bins) -> float:
    """Least cross entropy.  Candidates are whole numbers and split at the end of their bin; the
    result is the middle of the last candidate's bin."""
    mid, f = np.array(_moments(b)[0]), np.array(b[2], float)
    shift = min(b[0][0], 0.0)
    t, cut = float((mid * f).sum() / f.sum()), -1
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(10_000):
            cut = _bin(b, float(math.trunc(t + 0.5)))
            back, fore = ((mid[s] * f[s]).sum() / max(f[s].sum(), 1) - shift for s in (slice(cut + 1), slice(cut + 1, None)))
            new = (back - fore) / (np.log(back) - np.log(fore))
            if not math.isfinite(new):
                break
            new = math.trunc(new - 0.5 if new < 0 else new + 0.5) + shift
            if abs(new - t) <= 0.5:
                break
            t = new
    return float(mid[cut])


def _huang(b: Bins) -> float:
    """Least fuzziness.  A side's centre is the bin of its rounded mean value; the very first bin
    adds nothing to that mean's sum."""
    mid, f = np.array(_moments(b)[0]), np.array(b[2], float)
    if len(mid) == 1:
        return float(mid[0])
    used = np.flatnonzero(f)
    first, last = int(used[0]), int(used[-1])
    if first == last:
        return float(mid[0])
    share = 1 / (1 + np.arange(1, last - first + 1) / (last - first))
    term = np.concatenate(([0.0], -share * np.log(share) - (1 - share) * np.log(1 - share)))
    sums = mid * f
    sums[0] = 0.0

    def fuzziness(t: int) -> float:
        total = 0.0
        for side in (slice(first, t + 1), slice(t + 1, last + 1)):
            centre = _bin(b, math.floor(sums[side].sum() / f[side].sum() + 0.5))
            total += (term[np.minimum(np.abs(np.arange(side.start, side.stop) - centre), last - first)] * f[side]).sum()
        return total

    return float(mid[min(range(first, last), key=fuzziness)])


def _kittler_illingworth(b: Bins) -> float:
    """Least error of two Gaussians.  Steps go from bin to bin; the result is a bin's middle.  A side
    without spread is an error."""
    mid, f = np.array(_moments(b)[0]), np.array(b[2], float)
    if len(mid) == 1:
        return float(mid[0])
    tiny, total = np.finfo(float).eps, f.sum()
    at, before = _bin(b, float((mid * f).sum() / total)), -2
    for _ in range(10_000):
        if at == before:
            break
        weight, first, second = (float((mid**k * f)[: at + 1].sum()) for k in range(3))
        rest = [float((mid**k * f).sum()) - x for k, x in enumerate((weight, first, second))]
        if weight < tiny:
            raise ValueError("Kittler-Illingworth: nothing at or below the threshold")
        if rest[0] < tiny:
            break
        low, high = first / weight, rest[1] / rest[0]
        v, w = second / weight - low * low, rest[2] / rest[0] - high * high
        if v < tiny or abs(w) < tiny:
            raise ValueError("Kittler-Illingworth: a side has no spread")
        a, h = 1 / v - 1 / w, low / v - high / w
        c = low * low / v - high * high / w + math.log10(v * rest[0] ** 2 / (w * weight**2))
        root = h * h - a * c
        if root < tiny:
            break
        if abs(a) < tiny:
            at = _bin(b, -c / h)
        else:
            before, at = at, _bin(b, (h + math.sqrt(root)) / a)
    return float(mid[at])


def _renyi(b: Bins) -> float:
    p, below = _entropies(b)
    mid = _moments(b)[0]

    def cut(alpha: float) -> int:
        def score(k: int) -> float | None:
            lo, hi = below[k], 1 - below[k]
            if lo <= 0 or hi <= 1e-12:
                return None
            if alpha == 1:
                return -sum(x / lo * math.log(x / lo) for x in p[: k + 1] if x) - sum(x / hi * math.log(x / hi) for x in p[k + 1 :] if x)
            a, z = sum((x / lo) ** alpha for x in p[: k + 1]), sum((x / hi) ** alpha for x in p[k + 1 :])
            return math.log(a * z) / (1 - alpha) if a * z > 0 else 0.0

        return _best(score, len(p))

    one, two, three = sorted((cut(1), cut(0.5), cut(2)))
    near = (two - one <= 5, three - two <= 5)
    beta = {(True, True): (1, 2, 1), (True, False): (0, 1, 3), (False, True): (3, 1, 0), (False, False): (1, 2, 1)}[near]
    omega = below[three] - below[one]
    at = one * (below[one] + 0.25 * omega * beta[0]) + two * 0.25 * omega * beta[1] + three * (1 - below[three] + 0.25 * omega * beta[2])
    return mid[min(max(int(at), 0), len(mid) - 1)]


#: Threshold rules on a histogram of one image: bins are three lists (lower and upper edges, counts).
RULES: dict[str, Callable[[Bins], float]] = {
    "otsu": _otsu, "isodata": _isodata, "maximum_entropy": _maximum_entropy, "shanbhag": _shanbhag, "yen": _yen, "moments": _moments_threshold,
    "intermodes": _intermodes, "triangle": _triangle, "li": _li, "huang": _huang, "kittler_illingworth": _kittler_illingworth, "renyi_entropy": _renyi,
}


def _per_image(r: Raster, bins: int, rule: Callable[[Bins], list[float]]) -> DataFrame:
    """A rule applied to each image's histogram, which has a fixed number of bins."""
    import pandas as pd

    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        found = rule((rows["lower_edge"].tolist(), rows["upper_edge"].tolist(), rows["count"].tolist()))
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "thresholds": [found]})

    return histogram(r, bins).groupBy("image_id").applyInPandas(apply, "image_id long, thresholds array<double>")


def histogram_threshold(r: Raster, rule: str, bins: int = 256, inside: int = 1, outside: int = 0) -> tuple[Raster, DataFrame]:
    """The raster marked ``inside`` where v <= threshold, and (image_id, threshold)."""
    found = _per_image(r, bins, lambda b: [RULES[rule](b)]).select("image_id", F.element_at("thresholds", 1).alias("threshold"))
    rows = r.df.join(found, "image_id").withColumn("v", F.when(F.col("v") <= F.col("threshold"), inside).otherwise(outside))
    return r.with_rows(rows, pixel="uint8"), found


def otsu_multiple_thresholds(r: Raster, thresholds: int, bins: int = 128, label_offset: int = 0) -> tuple[Raster, DataFrame]:
    """Class number by ``thresholds`` cuts of greatest between-class variance, and the cuts."""
    found = _per_image(r, bins, lambda b: [b[1][k] for k in _otsu_cuts(b, thresholds)])
    number = F.size(F.filter("thresholds", lambda t: t < F.col("v").cast("double"))) + label_offset
    return r.with_rows(r.df.join(found, "image_id").withColumn("v", number), pixel="uint8"), found


def hash_image(r: Raster, function: str = "md5") -> DataFrame:
    """Digest of the values in raster order, as text joined by commas: image_id, digest."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(r.pos.alias("p"), F.col("v").cast("string").alias("v")))), lambda s: s["v"])
    text = F.concat_ws(",", ordered)
    return r.df.groupBy("image_id").agg((F.md5(text) if function == "md5" else F.sha1(text)).alias("digest"))


def scalar_image_kmeans(r: Raster, means: list[float], rounds: int = 100) -> tuple[Raster, DataFrame]:
    """Lloyd's rounds over the counts of distinct values of each image, from the same ``means``: the
    number of the nearest final mean (ties: the first), and image_id, means.

    A class without values keeps its mean.  A round joins one row for each image to the counts.
    """
    counts = staged(r.df.groupBy("image_id", F.col("v").cast("double").alias("v")).count())
    now = staged(counts.select("image_id").distinct().withColumn("means", F.array(*[F.lit(float(m)) for m in means])))
    nearest = lambda v: F.array_min(F.transform("means", lambda m, k: F.struct(F.abs(v - m).alias("d"), k.alias("k"))))["k"]
    for _ in range(rounds):
        found = counts.join(now, "image_id").groupBy("image_id", nearest(F.col("v")).alias("k")).agg((F.sum(F.col("v") * F.col("count")) / F.sum("count")).alias("m"))
        found = found.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("found"))
        moved = F.transform("means", lambda m, k: F.coalesce(F.element_at("found", k), m))
        new = staged(now.join(found, "image_id").select("image_id", moved.alias("means"), (moved != F.col("means")).alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    rows = r.df.join(now, "image_id").withColumn("v", nearest(F.col("v").cast("double")))
    return r.with_rows(rows, pixel="uint8"), now
