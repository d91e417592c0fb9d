"""Registration by metrics with gradients over all parameters of a transform.

The fixed image becomes a staged table of sample points; an evaluation maps the points,
reads the moving image with its gradient, and sums value and gradient in one aggregate, so
that a row of sums for each image reaches the driver.  A moving image of at most
BROADCAST_VOXELS goes to the tasks whole; a larger one is a table of cells (the corners of
each voxel's cell as one array) that points join by index.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import Geometry, Raster
from ..staging import staged
from .parametric import cubic, cubic_slope
from .resample import point_columns

#: Voxels of a moving image that is broadcast (8 bytes each), numbers of a chunk of sums, points worked on at once.
BROADCAST_VOXELS = 1 << 22
CHUNK = 1 << 13
POINTS = 1 << 14
METRICS = ("mean_squares", "correlation", "mattes")


def samples(fixed: Raster, mask: Raster | None = None, strategy: str = "none", percentage: float = 1.0, seed: int = 0) -> DataFrame:
    """Sample points of a fixed image: image_id, ``p`` and ``f``, staged.

    ``none`` takes every voxel, ``regular`` every ceil(1/percentage)-th in raster order,
    ``random`` floor(voxels * percentage) draws with replacement, the same for each image.
    A mask then drops the points where it is 0 or missing.
    """
    rows = fixed.df.select(*fixed.keys, F.col("v").cast("double").alias("f"))
    if strategy == "regular":
        rows = rows.where(fixed.pos % math.ceil(1 / percentage) == 0)
    elif strategy == "random":
        draws = fixed.df.sparkSession.range(int(fixed.geometry.count * percentage)).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(fixed.geometry.count)).alias("pos"))
        rows = rows.withColumn("pos", fixed.pos).join(draws, "pos").drop("pos")
    elif strategy != "none":
        raise ValueError("a strategy is none, regular or random")
    if mask is not None:
        rows = rows.join(mask.df.where("v <> 0").select(*fixed.keys), fixed.keys, "left_semi")
    return staged(rows.select("image_id", F.array(*point_columns(fixed.geometry, fixed.axes)).alias("p"), "f"))


@dataclass(frozen=True)
class Moving:
    """A moving image ready for evaluations: dense arrays that are broadcast, or a table of cells."""

    geometry: Geometry
    low: float
    high: float
    dense: object = None
    cells: DataFrame | None = None


def moving_image(r: Raster, mask: Raster | None = None, most: int = BROADCAST_VOXELS) -> Moving:
    """``r`` for evaluations; points nearest to a voxel where the mask is 0 or missing do not count."""
    rows = r.df.select(*r.keys, F.col("v").cast("double").alias("v"))
    if mask is not None:
        rows = rows.join(mask.df.where("v <> 0").select(*r.keys, F.lit(True).alias("in")), r.keys, "left")
    rows = staged(rows.select(*r.keys, "v", (F.coalesce("in", F.lit(False)) if mask is not None else F.lit(True)).alias("in")))
    low, high, images = rows.agg(F.min("v"), F.max("v"), F.countDistinct("image_id")).first()
    low, high = low or 0.0, high or 0.0
    if r.geometry.count * images <= most:
        got, size = rows.toArrow(), r.geometry.size
        image = got.column("image_id").to_numpy()
        at = tuple(got.column(a).to_numpy() for a in r.axes)
        dense = {}
        for i in np.unique(image).tolist():
            mine = image == i
            v, there = np.full(size, np.nan), np.zeros(size, bool)
            v[tuple(a[mine] for a in at)], there[tuple(a[mine] for a in at)] = got.column("v").to_numpy()[mine], got.column("in").to_numpy(zero_copy_only=False)[mine]
            dense[i] = (v, there)
        return Moving(r.geometry, low, high, r.df.sparkSession.sparkContext.broadcast(dense))
    # the corners of the cell that starts at a voxel, -1 included: each voxel is a corner of 2^d cells or more at the edge
    cells = rows
    for a in r.axes:
        n = r.size(a)
        step = F.array(*[F.struct((F.col(a) - k).cast("int").alias("cell"), F.lit(k).alias("corner")) for k in (0, 1)])
        low_edge = F.when(F.col(a) == 0, F.array(F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("corner")))).otherwise(F.array().cast("array<struct<cell:int,corner:int>>"))
        high_edge = F.when(F.col(a) == n - 1, F.array(F.struct(F.lit(n - 1).alias("cell"), F.lit(1).alias("corner")))).otherwise(F.array().cast("array<struct<cell:int,corner:int>>"))
        cells = cells.withColumn(a, F.explode(F.concat(step, low_edge, high_edge)))
    number = sum(F.col(a)["corner"] * 2**k for k, a in enumerate(r.axes))
    corner = F.struct(number.alias("number"), "v", "in")
    cells = cells.groupBy("image_id", *[F.col(a)["cell"].alias(f"i_{a}") for a in r.axes]).agg(F.array_sort(F.collect_list(corner)).alias("corners"))
    cells = cells.select("image_id", *[f"i_{a}" for a in r.axes], F.col("corners.v").alias("corners"), F.col("corners.in").alias("allowed"))
    return Moving(r.geometry, low, high, cells=staged(cells))


def _index(g: Geometry, q: np.ndarray) -> np.ndarray:
    return (q - g.origin) @ np.linalg.inv(np.array(g.direction) * g.spacing).T


def _interpolated(corners: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear interpolation and its gradient by index; ``corners``: 2^d columns, the first axis fastest."""
    n, d = part.shape
    value, slope = np.zeros(n), np.zeros((n, d))
    for c in range(2**d):
        bits = [c >> k & 1 for k in range(d)]
        w = [part[:, k] if b else 1 - part[:, k] for k, b in enumerate(bits)]
        value += np.prod(w, axis=0) * corners[:, c]
        for k in range(d):
            slope[:, k] += (1 if bits[k] else -1) * np.prod([x for j, x in enumerate(w) if j != k], axis=0) * corners[:, c]
    return value, slope


@dataclass
class _Sums:
    """What a metric sums in one pass over points."""

    metric: str
    bins: int = 0
    fixed: tuple[float, float] = (0.0, 1.0)
    moving: tuple[float, float] = (0.0, 1.0)
    ratio: dict = field(default_factory=dict)

    def place(self, v: np.ndarray, limits: tuple[float, float]) -> np.ndarray:
        return (v - limits[0]) / self.width(limits) + 2

    def width(self, limits: tuple[float, float]) -> float:
        return max(limits[1] - limits[0], 1e-12) / (self.bins - 4)

    def held(self, at: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(at), 2, self.bins - 3).astype(np.int64)

    def of(self, image: int, transform, p: np.ndarray, f: np.ndarray, m: np.ndarray, g: np.ndarray) -> np.ndarray:
        if self.metric == "mean_squares":
            d = m - f
            return np.concatenate(([len(f), (d * d).sum()], transform.moments(p, (2 * d[:, None] * g)[:, :, None]).ravel()))
        if self.metric == "correlation":
            sums = [len(f), f.sum(), m.sum(), (f * f).sum(), (m * m).sum(), (f * m).sum()]
            return np.concatenate((sums, transform.moments(p, np.stack([g, f[:, None] * g, m[:, None] * g], 2)).ravel()))
        a, at = self.held(self.place(f, self.fixed)), self.place(m, self.moving)
        first = self.held(at)
        if self.metric == "histogram":
            joint = np.zeros(self.bins**2)
            for k in (-1, 0, 1, 2):
                joint += np.bincount(a * self.bins + first + k, cubic(at - first - k), self.bins**2)
            return np.concatenate(([len(f)], joint))
        weight = np.zeros(len(f))
        for k in (-1, 0, 1, 2):
            weight += cubic_slope(at - first - k) * self.ratio[image][a, first + k]
        return np.concatenate(([len(f)], transform.moments(p, (weight[:, None] * g)[:, :, None]).ravel()))


def _tasks(transform, moving: Moving, sums: _Sums):
    """Sums over the points of a task, a row for each image and chunk."""
    geometry, dense = moving.geometry, moving.dense
    to_physical = np.linalg.inv(np.array(geometry.direction) * geometry.spacing)
    size = np.array(geometry.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, POINTS):
                b = whole.slice(start, POINTS)
                image = b.column("image_id").to_numpy()
                points = b.column("p").flatten().to_numpy().reshape(b.num_rows, -1)
                f = b.column("f").to_numpy()
                index = _index(geometry, transform.points(points))
                base = np.floor(index).astype(np.int64)
                near = np.clip(np.floor(index + 0.5).astype(np.int64), 0, size - 1)
                if dense is None:
                    d = len(size)
                    corners = b.column("corners").flatten().to_numpy().reshape(-1, 2**d)
                    allowed = b.column("allowed").flatten().to_numpy(zero_copy_only=False).reshape(-1, 2**d)
                    ahead = np.clip(near - base, 0, 1) @ (1 << np.arange(d))
                    good = allowed[np.arange(len(f)), ahead]
                else:
                    good = ((index >= -0.5) & (index < size - 0.5)).all(1)
                for i in np.unique(image).tolist():
                    rows = np.flatnonzero(good & (image == i))
                    if dense is None:
                        around = corners[rows]
                    elif i in dense.value:
                        v, there = dense.value[i]
                        rows = rows[there[tuple(near[rows].T)]]
                        bits = np.array(list(itertools.product((0, 1), repeat=len(size))))[:, ::-1]
                        at = np.clip(base[rows][:, None, :] + bits, 0, size - 1)
                        around = v[tuple(np.moveaxis(at, 2, 0))]
                    else:
                        continue
                    full = ~np.isnan(around).any(1)
                    rows, around = rows[full], around[full]
                    if len(rows):
                        m, slope = _interpolated(around, index[rows] - base[rows])
                        new = sums.of(i, transform, points[rows], f[rows], m, slope @ to_physical)
                        total[i] = new if i not in total else total[i] + new
        for i, t in total.items():
            for c in range(0, len(t), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([c // CHUNK], pa.int32()), pa.array([t[c : c + CHUNK].tobytes()])], names=["image_id", "chunk", "sums"])

    return run


def add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, key = None, None
    for b in batches:
        for row in b.to_pylist():
            v = np.frombuffer(row["sums"])
            total, key = v if total is None else total + v, row
    yield pa.RecordBatch.from_arrays([pa.array([key["image_id"]]), pa.array([key["chunk"]], pa.int32()), pa.array([total.tobytes()])], names=["image_id", "chunk", "sums"])


def _total(points: DataFrame, moving: Moving, transform, sums: _Sums) -> dict[int, np.ndarray]:
    """The sums of each image that has a valid point."""
    rows = points
    if moving.cells is not None:
        g, axes = moving.geometry, [c for c in moving.cells.columns if c.startswith("i_")]
        size = np.array(g.size)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                index = _index(g, transform.points(b.column("p").flatten().to_numpy().reshape(b.num_rows, len(axes))))
                good = ((index >= -0.5) & (index < size - 0.5)).all(1)
                kept = b.filter(pa.array(good))
                base = np.floor(index[good]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(base[:, k]) for k in range(len(axes)))], names=[*b.schema.names, *axes])

        rows = points.mapInArrow(placed, "image_id long, p array<double>, f double, " + ", ".join(f"{a} int" for a in axes)).join(moving.cells, ["image_id", *axes])
    kinds = "image_id long, chunk int, sums binary"
    out: dict[int, list] = {}
    for r in rows.mapInArrow(_tasks(transform, moving, sums), kinds).groupBy("image_id", "chunk").applyInArrow(add_sums, kinds).collect():
        out.setdefault(r.image_id, []).append((r.chunk, np.frombuffer(r.sums)))
    return {i: np.concatenate([v for _, v in sorted(parts, key=lambda x: x[0])]) for i, parts in out.items()}


@dataclass(frozen=True)
class Value:
    """A metric's value, its gradient over the parameters, and the points it counts."""

    value: float
    gradient: np.ndarray
    points: int


def evaluate(points: DataFrame, moving: Moving, transform, metric: str = "mean_squares", bins: int = 50) -> dict[int, Value]:
    """The metric of each image that has a valid point; smaller is better for all metrics.

    ``mean_squares``: mean squared difference.  ``correlation``: negative squared correlation (0 if
    a side is flat).  ``mattes``: negative mutual information of the histogram in which a pair
    counts in one bin of the fixed value and, by a cubic spline, in four of the moving one.
    """
    if metric not in METRICS:
        raise ValueError(f"a metric is one of {METRICS}")
    out = {}
    if metric == "mean_squares":
        for i, s in _total(points, moving, transform, _Sums(metric)).items():
            out[i] = Value(float(s[1] / s[0]), transform.gradient(s[2:].reshape(-1, 1))[:, 0] / s[0], int(s[0]))
    elif metric == "correlation":
        for i, s in _total(points, moving, transform, _Sums(metric)).items():
            n, f, m, ff, mm, fm = s[:6]
            g, fg, mg = transform.gradient(s[6:].reshape(-1, 3)).T
            both, left, right = fm - f * m / n, ff - f * f / n, mm - m * m / n
            if left * right <= np.finfo(float).eps * abs(ff * mm):
                out[i] = Value(0.0, np.zeros(len(g)), int(n))
                continue
            slope = -2 * both / (left * right) * (fg - f / n * g - both / right * (mg - m / n * g))
            out[i] = Value(float(-both * both / (left * right)), slope, int(n))
    else:
        low, high = points.agg(F.min("f"), F.max("f")).first()
        if low is None:
            return {}
        limits = dict(bins=bins, fixed=(low, high), moving=(moving.low, moving.high))
        ratio, value, count = {}, {}, {}
        for i, s in _total(points, moving, transform, _Sums("histogram", **limits)).items():
            p = s[1:].reshape(bins, bins) / s[1:].sum()
            a, b = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
            known = p > 0
            value[i] = -float((p[known] * np.log(p[known] / (a * b)[known])).sum())
            ratio[i], count[i] = np.zeros_like(p), int(s[0])
            ratio[i][known] = np.log(p[known] / np.broadcast_to(b, p.shape)[known])
        width = _Sums("mattes", bins=bins).width(limits["moving"])
        for i, s in _total(points, moving, transform, _Sums("mattes", ratio=ratio, **limits)).items():
            out[i] = Value(value[i], -transform.gradient(s[1:].reshape(-1, 1))[:, 0] / (count[i] * width), count[i])
    return out


@dataclass(frozen=True)
class Found:
    """What an optimiser found, why it stopped, and the values on the way."""

    parameters: np.ndarray
    value: float
    iterations: int
    reason: str
    course: tuple[float, ...]


Slope = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _line_search(cost: Slope, x: np.ndarray, f: float, slope: float, along: np.ndarray, step: float, most: int, armijo: float = 1e-4, wolfe: float = 0.9):
    """A step that meets the strong Wolfe conditions: it grows until the minimum is bracketed, then
    the bracket shrinks by cubic interpolation.  None if no step is found in ``most`` calls."""
    low, high = (0.0, f, slope), None
    for _ in range(most):
        value, g = cost(x + step * along)
        d = float(g @ along)
        if not value <= f + armijo * step * slope or (low[0] and value >= low[1]):
            high = (step, value, d)
        elif abs(d) <= -wolfe * slope:
            return step, value, g
        elif d * ((high[0] if high else step + 1) - low[0]) >= 0:
            high, low = low, (step, value, d)
        else:
            low = (step, value, d)
        if high is None:
            step *= 2
            continue
        (a, fa, da), (b, fb, db) = low, high
        if abs(b - a) < 1e-14 * max(1.0, abs(a)):
            return None
        bend = da + db - 3 * (fa - fb) / (a - b)
        root = bend * bend - da * db
        step = (a + b) / 2
        if root >= 0 and np.isfinite(root):
            root = math.copysign(math.sqrt(root), b - a)
            if db - da + 2 * root:
                step = b - (b - a) * (db + root - bend) / (db - da + 2 * root)
        edge = 0.1 * abs(b - a)
        step = min(max(step, min(a, b) + edge), max(a, b) - edge)
    return None


def _direction(g: np.ndarray, pairs: list, free: np.ndarray) -> np.ndarray:
    """Minus the gradient times the inverse curvature of the last steps, on the free parameters."""
    d, used = np.where(free, -g, 0.0), []
    for s, y in reversed(pairs):
        s, y = np.where(free, s, 0.0), np.where(free, y, 0.0)
        sy = float(s @ y)
        if sy <= 1e-12 * float(y @ y):
            continue
        a = float(s @ d) / sy
        d = d - a * y
        used.append((s, y, sy, a))
    if used:
        s, y, sy, _ = used[0]
        d = d * (sy / float(y @ y))
    for s, y, sy, a in reversed(used):
        d = d + (a - float(y @ d) / sy) * s
    return d


def lbfgs(cost: Slope, start: Sequence[float], memory: int = 6, accuracy: float = 1e-5, past: int = 0, delta: float = 1e-5, rounds: int = 0, evaluations: int = 40, bounds: tuple[Sequence[float], Sequence[float]] | None = None) -> Found:
    """Limited-memory BFGS.  ``cost`` gives value and gradient.

    It stops when the gradient (projected on the bounds) is at most ``accuracy`` times the length
    of the parameters or 1 (``gradient``), when the value of ``past`` rounds ago differs by less
    than ``delta`` relatively (``converged``), after ``rounds`` (0: no limit; ``rounds``) or
    when no step is found (``line_search``).  Within ``bounds`` parameters at a bound that the
    gradient pushes out stay there, and steps are bent to the box and halved until they help.
    """
    low, high = (np.array(b, float) for b in bounds) if bounds else (-np.inf, np.inf)
    x = np.clip(np.array(start, float), low, high)
    f, g = cost(x)
    course, pairs, n = [f], [], 0
    while True:
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if np.linalg.norm(g[free]) <= accuracy * max(1.0, np.linalg.norm(x)):
            return Found(x, f, n, "gradient", tuple(course))
        if past and n >= past and abs(course[n - past] - f) < delta * abs(f):
            return Found(x, f, n, "converged", tuple(course))
        if rounds and n >= rounds:
            return Found(x, f, n, "rounds", tuple(course))
        along = _direction(g, pairs, free)
        if not along @ g < 0:
            pairs, along = [], np.where(free, -g, 0.0)
        step = 1.0 if pairs else 1.0 / np.linalg.norm(along)
        if bounds is None:
            found = _line_search(cost, x, f, float(g @ along), along, step, evaluations)
            new = found and (x + found[0] * along, *found[1:])
        else:
            new = None
            for _ in range(evaluations):
                y = np.clip(x + step * along, low, high)
                value, slope = cost(y)
                if value <= f + 1e-4 * float(g @ (y - x)):
                    new = (y, value, slope) if (y != x).any() else None
                    break
                step /= 2
        if new is None:
            if pairs:
                pairs = []
                continue
            return Found(x, f, n, "line_search", tuple(course))
        if float((new[2] - g) @ (new[0] - x)) > 0:
            pairs = [*pairs, (new[0] - x, new[2] - g)][-memory:]
        (x, f, g), n = new, n + 1
        course.append(f)


def regular_step(cost: Slope, start: Sequence[float], step: float = 1.0, shortest: float = 1e-4, rounds: int = 100, relaxation: float = 0.5, accuracy: float = 1e-4) -> Found:
    """Steps of a fixed length against the gradient; the length shrinks when the gradient turns.
    Stops: ``gradient``, ``step`` (too short) or ``rounds``."""
    x, before, course = np.array(start, float), None, []
    for n in range(rounds):
        f, g = cost(x)
        course.append(f)
        norm = np.linalg.norm(g)
        if norm < accuracy:
            return Found(x, f, n, "gradient", tuple(course))
        if before is not None and g @ before < 0:
            step *= relaxation
        if step < shortest:
            return Found(x, f, n, "step", tuple(course))
        x, before = x - step * g / norm, g
    f, _ = cost(x)
    return Found(x, f, rounds, "rounds", (*course, f))


def shift_scales(transform, g: Geometry, step: float = 1e-2) -> np.ndarray:
    """For each parameter the largest squared shift of a corner of the grid, for a unit of it."""
    ends = [(-0.5, n - 0.5) for n in g.size]
    corners = np.array([g.to_point(c) for c in itertools.product(*ends)])
    p, here, out = np.array(transform.parameters, float), transform.points(corners), []
    for k in range(len(p)):
        q = p.copy()
        q[k] += step
        out.append((((transform.with_parameters(q).points(corners) - here) / step) ** 2).sum(1).max())
    return np.maximum(np.array(out), np.finfo(float).tiny)


def register(
    fixed: Raster, moving: Raster, transform, metric: str = "mean_squares", optimizer: str = "lbfgs", bins: int = 50, scales: Sequence[float] | None = None, fixed_mask: Raster | None = None, moving_mask: Raster | None = None,
    strategy: str = "none", percentage: float = 1.0, seed: int = 0, factors: Sequence[int] = (1,), sigmas: Sequence[float] = (0.0,), most: int = BROADCAST_VOXELS, **options,
):
    """The transform from fixed to moving points at which the metric is least, and what the
    optimiser reports of the last level.

    Levels go from coarse to fine: both images are smoothed by a Gaussian of ``sigmas`` voxels, the
    fixed one shrunk by ``factors``.  ``scales`` divide the squares of steps; the default is 1 for
    every parameter.  Rasters hold one image each.  Without a valid point at the start it fails;
    a step that leaves none counts as infinitely bad.
    """
    from .geometry import shrink
    from .lines import discrete_gaussian

    found = None
    for factor, sigma in zip(factors, sigmas):
        real = [Raster(r.df.withColumn("v", F.col("v").cast("double")), r.geometry, r.pixel) for r in (fixed, moving)]
        smooth = [discrete_gaussian(r, sigma * sigma) if sigma else r for r in real]
        less = lambda r: shrink(r, [factor] * r.dim) if factor > 1 else r  # noqa: B023, E731
        points = samples(less(smooth[0]), fixed_mask and less(fixed_mask), strategy, percentage, seed)
        image = moving_image(smooth[1], moving_mask, most)
        root = np.sqrt(np.ones(len(transform.parameters)) if scales is None else np.array(scales, float))

        def cost(u: np.ndarray) -> tuple[float, np.ndarray]:
            got = evaluate(points, image, transform.with_parameters(u / root), metric, bins)  # noqa: B023
            if len(got) > 1:
                raise ValueError("register one image at a time")
            return next(((v.value, v.gradient / root) for v in got.values()), (math.inf, np.zeros(len(u))))  # noqa: B023

        start = np.array(transform.parameters, float) * root
        if math.isinf(cost(start)[0]):
            raise ValueError("no sample point falls on the moving image")
        found = {"lbfgs": lbfgs, "regular_step": regular_step}[optimizer](cost, start, **options)
        transform = transform.with_parameters(found.parameters / root)
    return transform, found
