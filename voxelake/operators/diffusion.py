"""Iterated filters: diffusion, level-set evolution, deformable registration, deconvolution, edges.

Each round is a plan of window frames over lines; rounds are staged in the shared folder, so
lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..raster import PIXELS, Geometry, Raster
from ..staging import staged
from .labels import connected_component
from .lines import discrete_gaussian, forward_fft, inverse_fft, smooth_gaussian
from .pixelwise import binary_threshold
from .window import box_tap, curvature_speed, curvature_terms, gradient, laplacian, plane_only, taps


def _steps(r: Raster, iterations: int, step: Callable[[Raster], Raster]) -> Raster:
    now = r.map(lambda v: v.cast("double"), "float64")
    for _ in range(iterations):
        now = step(now)
        now = now.with_rows(staged(now.df))
    return now


def _mean_square_slope(r: Raster) -> DataFrame:
    """image_id and the mean of its squared gradient norms (1 for a flat image)."""
    mean = F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return gradient(r).df.groupBy("image_id").agg(mean.alias("square")).withColumn("square", F.when(F.col("square") > 0, F.col("square")).otherwise(1.0))


def gradient_anisotropic_diffusion(r: Raster, time_step: float = 0.125, conductance: float = 1.0, iterations: int = 5) -> Raster:
    """Diffusion that slows across edges: each neighbour difference is weighted by
    exp(-(difference / K)^2 / 2), K the conductance times the image's mean gradient norm (root of the mean square) of the round."""

    def step(now: Raster) -> Raster:
        k = conductance * F.sqrt("square")
        v = F.col("v")
        parts, df = [], now.df.join(_mean_square_slope(now), "image_id")
        for i, a in enumerate(now.axes):
            line = now.line(a)
            df = df.withColumn(f"a{i}", F.coalesce(F.lag("v").over(line), "v")).withColumn(f"b{i}", F.coalesce(F.lead("v").over(line), "v"))
            parts += [(F.col(f"{s}{i}") - v) * F.exp(-F.pow((F.col(f"{s}{i}") - v) / k, 2) / 2) for s in "ab"]
        return now.with_rows(df.withColumn("v", v + time_step * reduce(lambda x, y: x + y, parts)))

    return _steps(r, iterations, step)


def curvature_anisotropic_diffusion(r: Raster, time_step: float = 0.0625, conductance: float = 3.0, iterations: int = 5) -> Raster:
    """Motion by curvature, slowed by the same conductance, in any dimension."""
    centre = box_tap(r.dim)(*[0] * r.dim)
    square, _ = curvature_terms(r.dim)

    def step(now: Raster) -> Raster:
        w = taps(now, [1] * r.dim).df.join(_mean_square_slope(now).withColumnRenamed("square", "mean_square"), "image_id")
        slow = F.exp(-square / (2 * conductance**2 * F.col("mean_square")))
        return now.with_rows(w.select(*now.keys, (centre + time_step * curvature_speed(r.dim) * slow).alias("v")))

    return _steps(r, iterations, step)


def min_max_curvature_flow(r: Raster, time_step: float = 0.05, iterations: int = 5) -> Raster:
    """Curvature flow that only shrinks where the box mean is below the value, and only grows where
    it is above."""
    from .window import curvature_flow, mean

    def step(now: Raster) -> Raster:
        moved = curvature_flow(now, time_step, 1)
        rows = now.zip(moved, mean(now, [1] * now.dim))
        change = F.col("v1") - F.col("v0")
        return now.with_rows(rows.withColumn("v", F.col("v0") + F.when(F.col("v2") < F.col("v0"), F.least(change, F.lit(0.0))).otherwise(F.greatest(change, F.lit(0.0)))))

    return _steps(r, iterations, step)


def level_set(initial: Raster, speed: Raster, propagation: float = 1.0, curvature: float = 0.2, time_step: float = 0.2, iterations: int = 20) -> Raster:
    """Evolves a level set (negative inside) outward with ``speed``, smoothed by its curvature:
    upwind gradient for propagation, central differences for curvature, in any dimension."""
    fast = speed.df.select(*speed.keys, F.col("v").cast("double").alias("s"))
    t, dim, zero = box_tap(initial.dim), initial.dim, F.lit(0.0)
    centre = t(*[0] * dim)
    ends = [[t(*(o if i == k else 0 for i in range(dim))) for o in (-1, 1)] for k in range(dim)]
    up = F.sqrt(reduce(lambda x, y: x + y, [F.pow(F.greatest(centre - a, zero), 2) + F.pow(F.least(b - centre, zero), 2) for a, b in ends]))
    square, bend = curvature_terms(dim)
    change = -propagation * F.col("s") * up + curvature * F.col("s") * bend / F.greatest(square, F.lit(1e-9))

    def step(now: Raster) -> Raster:
        w = taps(now, [1] * dim).df.join(fast, now.keys)
        return now.with_rows(w.select(*now.keys, (centre + time_step * change).alias("v")))

    return _steps(initial, iterations, step)


def demons(fixed: Raster, moving: Raster, iterations: int = 10, sigma: float = 1.0) -> Raster:
    """Displacement field that brings the moving raster onto the fixed one: force
    (f - m) grad f / (|grad f|^2 + (f - m)^2), smoothed each round."""
    from .resample import warp

    fixed, moving = (r.map(lambda v: v.cast("double"), "float64") for r in (fixed, moving))
    slope = gradient(fixed)
    field = Raster(fixed.df.select(*fixed.keys, F.array(*[F.lit(0.0)] * fixed.dim).alias("v")), fixed.geometry, PIXELS["float64"])
    for _ in range(iterations):
        rows = fixed.zip(warp(moving, field), slope, field)
        d = F.col("v0") - F.col("v1")
        square = F.aggregate("v2", F.lit(0.0), lambda s, x: s + x * x)
        below = square + d * d
        gain = F.when(below > 1e-9, d / F.when(below > 1e-9, below).otherwise(1.0)).otherwise(0.0)
        new = rows.select(*fixed.keys, F.zip_with("v3", "v2", lambda a, g: a + gain * g).alias("v"))
        parts = [smooth_gaussian(Raster(new.withColumn("v", F.col("v")[k]), fixed.geometry, PIXELS["float64"]), sigma) for k in range(fixed.dim)]
        joined = parts[0].zip(*parts[1:])
        field = Raster(staged(joined.select(*fixed.keys, F.array(*[F.col(f"v{k}") for k in range(fixed.dim)]).alias("v"))), fixed.geometry, PIXELS["float64"])
    return field


def _spectral(a: Raster, b: Raster, value: Callable[[Column, Column, Column, Column], tuple[Column, Column]]) -> Raster:
    """Inverse transform of an expression of two spectra."""
    rows = forward_fft(a).zip(forward_fft(b))
    re, im = value(F.col("v0.re"), F.col("v0.im"), F.col("v1.re"), F.col("v1.im"))
    return inverse_fft(Raster(rows.select(*a.keys, F.struct(re.alias("re"), im.alias("im")).alias("v")), a.geometry, PIXELS["float64"]))


def fft_convolution(r: Raster, kernel: Raster) -> Raster:
    """Periodic convolution with a kernel on the same grid whose centre is voxel 0."""
    return _spectral(r, kernel, lambda a, b, c, d: (a * c - b * d, a * d + b * c))


def wiener_deconvolution(r: Raster, kernel: Raster, noise_variance: float = 0.0) -> Raster:
    """Each frequency times conj(H) / (|H|^2 + Pn / Pf): Pn is the noise's power (``noise_variance``
    times the voxels), Pf the signal's, estimated as |G|^2 - Pn; without signal power it is 0."""
    noise = noise_variance * r.geometry.count

    def value(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
        signal = a * a + b * b - noise
        below = c * c + d * d + F.lit(float(noise)) / F.when(signal > 0, signal).otherwise(1.0)
        ok = (signal > 0) & (below > 0)
        part = lambda x: F.when(ok, x / F.when(ok, below).otherwise(1.0)).otherwise(0.0)
        return part(a * c + b * d), part(b * c - a * d)

    return _spectral(r, kernel, value)


def tikhonov_deconvolution(r: Raster, kernel: Raster, weight: float = 1e-3) -> Raster:
    """Each frequency times conj(H) / (|H|^2 + weight)."""
    return _spectral(r, kernel, lambda a, b, c, d: ((a * c + b * d) / (c * c + d * d + weight), (b * c - a * d) / (c * c + d * d + weight)))


def richardson_lucy(r: Raster, kernel: Raster, iterations: int = 5) -> Raster:
    """Multiplicative updates by the back-projected ratio of data and estimate."""
    real = r.map(lambda v: v.cast("double"), "float64")

    def step(now: Raster) -> Raster:
        seen = fft_convolution(now, kernel)
        ratio = real.with_rows(real.zip(seen).withColumn("v", F.when(F.abs(F.col("v1")) > 1e-9, F.col("v0") / F.col("v1")).otherwise(0.0)))
        back = _spectral(ratio, kernel, lambda a, b, c, d: (a * c + b * d, b * c - a * d))
        return now.with_rows(now.zip(back).withColumn("v", F.col("v0") * F.col("v1")))

    return _steps(real, iterations, step)


def landweber(r: Raster, kernel: Raster, alpha: float = 0.5, iterations: int = 5, positive: bool = False) -> Raster:
    """Gradient steps on the squared residual."""
    real = r.map(lambda v: v.cast("double"), "float64")

    def step(now: Raster) -> Raster:
        seen = fft_convolution(now, kernel)
        rest = real.with_rows(real.zip(seen).withColumn("v", F.col("v0") - F.col("v1")))
        back = _spectral(rest, kernel, lambda a, b, c, d: (a * c + b * d, b * c - a * d))
        new = F.col("v0") + alpha * F.col("v1")
        return now.with_rows(now.zip(back).withColumn("v", F.greatest(new, F.lit(0.0)) if positive else new))

    return _steps(real, iterations, step)


def canny_edge_detection(r: Raster, variance: float = 1.0, lower: float = 0, upper: float = 0) -> Raster:
    """Edges of a 2-D raster: Gaussian, maxima of the gradient norm along its direction, and
    hysteresis (weak edges that touch a strong one stay)."""
    plane_only(r, "canny_edge_detection")
    smooth = discrete_gaussian(r.map(lambda v: v.cast("double"), "float64"), variance)
    slope = gradient(smooth)
    norm = Raster(slope.df.select(*r.keys, F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("v")), r.geometry, PIXELS["float64"])
    box = taps(norm, (1, 1)).df.withColumnRenamed("v", "w").join(slope.df.withColumnRenamed("v", "g"), r.keys)
    t = lambda i, j: F.element_at("w", (j + 1) * 3 + i + 2)
    gx, gy = F.col("g")[0], F.col("g")[1]
    ax, ay = F.abs(gx), F.abs(gy)
    pair = F.when(ay <= 0.41421356237309503 * ax, F.array(t(-1, 0), t(1, 0))).when(ax <= 0.41421356237309503 * ay, F.array(t(0, -1), t(0, 1))).when(gx * gy > 0, F.array(t(-1, -1), t(1, 1))).otherwise(F.array(t(1, -1), t(-1, 1)))
    top = norm.with_rows(box.select(*r.keys, F.when((t(0, 0) > pair[0]) & (t(0, 0) >= pair[1]), t(0, 0)).otherwise(0.0).alias("v")))
    weak = binary_threshold(top, max(lower, 1e-12), float("inf"))
    labels = connected_component(weak, fully_connected=True)
    rows = labels.zip(top)
    strong = rows.where((F.col("v0") > 0) & (F.col("v1") >= upper)).select("image_id", "v0").distinct().withColumn("s", F.lit(1))
    kept = rows.join(strong, ["image_id", "v0"], "left").withColumn("v", F.when((F.col("v0") > 0) & F.col("s").isNotNull(), 1).otherwise(0))
    return r.with_rows(kept, pixel="uint8")


def adaptive_histogram_equalization(r: Raster, radius: tuple[int, ...], alpha: float = 0.3, beta: float = 0.3) -> Raster:
    """Local power-law equalisation: with values scaled to [-1/2, 1/2], the mean over the box of
    sign(d) |2d|^alpha / 2 blended by beta with the value itself."""
    from .reduce import minimum_maximum

    low, high = F.col("minimum").cast("double"), F.col("maximum").cast("double")
    span = F.when(high > low, high - low).otherwise(1.0)
    centre = 1
    for k in radius:
        centre *= 2 * k + 1
    unit = lambda x: (x.cast("double") - low) / span - 0.5

    def value(w: Column) -> Column:
        own = unit(F.element_at(w, centre // 2 + 1))

        def cumulative(x: Column) -> Column:
            d = own - unit(x)
            return 0.5 * F.signum(d) * F.pow(F.abs(2 * d), F.lit(alpha)) - 0.5 * beta * F.signum(d) * F.abs(2 * d) + beta * own

        total = F.aggregate(w, F.lit(0.0), lambda s, x: s + cumulative(x))
        return (total / centre + 0.5) * span + low

    rows = taps(r, radius).df.join(minimum_maximum(r), "image_id")
    return Raster(rows.select(*r.keys, value(F.col("v")).alias("v")), r.geometry, PIXELS["float64"])


def objectness_measure(r: Raster, alpha: float = 0.5, gamma: float = 5.0, bright: bool = True) -> Raster:
    """Line-likeness of a 2-D raster from the Hessian's eigenvalues: near zero along the line, large
    and of one sign across it."""
    plane_only(r, "objectness_measure")
    w = taps(r.map(lambda v: v.cast("double"), "float64"), (1, 1)).df
    t = box_tap(2)
    xx, yy, xy = t(1, 0) - 2 * t(0, 0) + t(-1, 0), t(0, 1) - 2 * t(0, 0) + t(0, -1), (t(1, 1) - t(-1, 1) - t(1, -1) + t(-1, -1)) / 4
    half, root = (xx + yy) / 2, F.sqrt(F.pow((xx - yy) / 2, 2) + xy * xy)
    one, two = half + root, half - root
    big, small = F.when(F.abs(one) >= F.abs(two), one).otherwise(two), F.when(F.abs(one) >= F.abs(two), two).otherwise(one)
    ratio = F.when(big != 0, small / F.when(big != 0, big).otherwise(1.0)).otherwise(0.0)
    right = big < 0 if bright else big > 0
    value = F.when(right, F.exp(-ratio * ratio / (2 * alpha * alpha)) * (1 - F.exp(-(one * one + two * two) / (2 * gamma * gamma)))).otherwise(0.0)
    return Raster(w.select(*r.keys, value.alias("v")), r.geometry, PIXELS["float64"])


def zero_crossing_based_edge_detection(r: Raster, variance: float = 1.0) -> Raster:
    from .window import zero_crossing

    return zero_crossing(laplacian(discrete_gaussian(r, variance)))


def histogram_matching(source: Raster, reference: Raster, points: int = 7) -> Raster:
    """Piecewise-linear map of the source's quantiles onto the reference's (exact percentiles at
    ``points`` interior places, and the extremes)."""
    cuts = F.array(*[F.lit(k / (points + 1)) for k in range(points + 2)])
    table = lambda r, name: r.df.groupBy("image_id").agg(F.percentile(F.col("v").cast("double"), cuts).alias(name))
    rows = source.df.join(table(source, "a").join(table(reference, "b"), "image_id"), "image_id")
    v, a, b = F.col("v").cast("double"), (lambda k: F.col("a")[k]), (lambda k: F.col("b")[k])
    value = b(points + 1)
    for k in reversed(range(points + 1)):
        width = F.when(a(k + 1) > a(k), a(k + 1) - a(k)).otherwise(1.0)
        value = F.when(v < a(k + 1), b(k) + (v - a(k)) * ((b(k + 1) - b(k)) / width)).otherwise(value)
    return source.with_rows(rows.withColumn("v", source.pixel.saturate(value)))


def inverse_deconvolution(r: Raster, kernel: Raster, threshold: float = 1e-4) -> Raster:
    """Division of spectra; frequencies at which the kernel's magnitude is below ``threshold`` are 0."""
    power = lambda c, d: c * c + d * d
    part = lambda x, c, d: F.when(F.sqrt(power(c, d)) < threshold, 0.0).otherwise(x / F.when(power(c, d) > 0, power(c, d)).otherwise(1.0))
    return _spectral(r, kernel, lambda a, b, c, d: (part(a * c + b * d, c, d), part(b * c - a * d, c, d)))


def projected_landweber(r: Raster, kernel: Raster, alpha: float = 0.5, iterations: int = 5) -> Raster:
    """Landweber steps whose negative values become 0."""
    return landweber(r, kernel, alpha, iterations, positive=True)


def stable_time_step_bound(geometry: Geometry, use_spacing: bool = True) -> float:
    """The largest stable time step of the diffusion filters: least spacing over 2**(dim + 1)."""
    return (min(geometry.spacing) if use_spacing else 1.0) / 2 ** (len(geometry.size) + 1)
