"""Line kernels: Gaussian and recursive filters, Fourier transforms and distance maps.

A separable filter is one pass for each axis.  A pass groups voxels by line (all axes but
one), so a task holds single lines, whatever the size of the image; NumPy works on blocks
of lines of equal length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..raster import PIXELS, Raster

Kernel = Callable[[np.ndarray], np.ndarray]


def along(r: Raster, axis: str, kernel: Kernel, pixel: str = "float64") -> Raster:
    """Apply ``kernel`` to every line along ``axis``: (lines, n) array to (lines, n) array.

    Lines become array rows by an aggregation (the only shuffle), the kernel runs on Arrow
    batches of lines, and the rows are exploded back.
    """
    others = [a for a in r.axes if a != axis]
    lines = r.df.groupBy("image_id", *others).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, F.col("v").cast("double").alias("v")))), lambda s: s["v"]).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            values = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            out = np.ascontiguousarray(kernel(values), dtype=float)
            offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            cols = [pa.ListArray.from_arrays(offsets, pa.array(out.ravel())) if c == "v" else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    schema = ", ".join(f"{c} {t}" for c, t in lines.dtypes)
    done = lines.mapInArrow(run, schema)
    rows = done.select("image_id", *others, F.posexplode("v").alias(axis, "v"))
    return Raster(rows.select(*r.keys, F.col("v").cast(PIXELS[pixel].spark).alias("v")), r.geometry, PIXELS[pixel], r.meta)


def fir(weights: Sequence[float]) -> Kernel:
    """Convolution with an odd symmetric-length kernel, edge repeated."""
    w = np.asarray(weights, float)
    k = len(w) // 2

    def run(lines: np.ndarray) -> np.ndarray:
        padded = np.pad(lines, ((0, 0), (k, k)), mode="edge")
        out = np.zeros_like(lines)
        for i, x in enumerate(w[::-1]):
            out += x * padded[:, i : i + lines.shape[1]]
        return out

    return run


def bessel_kernel(variance: float, maximum_error: float = 0.01, width: int = 32) -> list[float]:
    """Discrete Gaussian: e^-t I_k(t), until the sum reaches 1 - maximum_error or the width ends,
    then normalised.  The modified Bessel functions come from their integral."""
    angle = (np.arange(2000) + 0.5) * np.pi / 2000
    scaled = lambda k: float(np.mean(np.exp(variance * (np.cos(angle) - 1)) * np.cos(k * angle)))
    half = [scaled(0)]
    while half[0] + 2 * sum(half[1:]) < 1 - maximum_error and len(half) <= width // 2:
        half.append(scaled(len(half)))
    full = half[:0:-1] + half
    return [x / sum(full) for x in full]


def discrete_gaussian(r: Raster, variance: float, maximum_error: float = 0.01, width: int = 32) -> Raster:
    for a, s in zip(r.axes, r.geometry.spacing):
        r = along(r, a, fir(bessel_kernel(variance / s**2, maximum_error, width)))
    return r


def derivative_weights(order: int) -> list[float]:
    """Central differences of an order on the grid: pairs of second differences, one first one if odd."""
    w = np.ones(1)
    for _ in range(order // 2):
        w = np.convolve(w, [1.0, -2.0, 1.0])
    return (np.convolve(w, [-0.5, 0.0, 0.5]) if order % 2 else w).tolist()


def discrete_gaussian_derivative(r: Raster, variance: Sequence[float], order: Sequence[int], maximum_error: float = 0.01, width: int = 32, use_spacing: bool = True, normalize: bool = False) -> Raster:
    """A discrete Gaussian and central differences of an order for each axis, as one kernel an axis;
    ``normalize`` scales by sigma to the order."""
    for a, s, t, n in zip(r.axes, r.geometry.spacing, variance, order):
        h = s if use_spacing else 1.0
        scale = (math.sqrt(t) ** n if normalize else 1.0) / h**n
        w = np.convolve(bessel_kernel(t / h**2, maximum_error, width), derivative_weights(n)) * scale
        r = along(r, a, fir(w[::-1]))  # fir turns the weights round, as a convolution does
    return r


def smooth_gaussian(r: Raster, sigma: float) -> Raster:
    """Truncated Gaussian of radius ceil(4 sigma)."""
    for a, s in zip(r.axes, r.geometry.spacing):
        k = max(1, math.ceil(4 * sigma / s))
        w = np.exp(-((np.arange(-k, k + 1) * s) ** 2) / (2 * sigma**2))
        r = along(r, a, fir(w / w.sum()))
    return r


def binomial_blur(r: Raster, repetitions: int = 1) -> Raster:
    for _ in range(repetitions):
        for a in r.axes:
            r = along(r, a, fir([0.25, 0.5, 0.25]))
    return r


def unsharp_mask(r: Raster, sigma: float, amount: float = 0.5, threshold: float = 0) -> Raster:
    """Adds ``amount`` of what the blur took away beyond a threshold."""
    rows = r.map(lambda v: v.cast("double"), "float64").zip(smooth_gaussian(r, sigma))
    d = F.col("v0") - F.col("v1")
    extra = F.when(F.abs(d) > threshold, F.signum(d) * (F.abs(d) - threshold)).otherwise(0.0)
    return Raster(rows.select(*r.keys, (F.col("v0") + amount * extra).alias("v")), r.geometry, PIXELS["float64"])


# Coefficients of the fourth-order recursive approximation of a Gaussian and its derivatives
# (published by R. Deriche, 1993): a0, a1, w0, b0, c0, c1, w1, b1 of sums of damped cosines.
DERICHE = {
    0: (1.680, 3.735, 0.6318, 1.783, -0.6803, -0.2598, 1.997, 1.723),
    1: (-0.6472, -4.531, 0.6719, 1.527, 0.6494, 0.9557, 2.072, 1.516),
    2: (-1.331, 3.661, 0.7480, 1.240, 0.3225, -1.738, 2.166, 1.314),
}


def recursive_kernel(sigma: float, order: int = 0) -> Kernel:
    """The causal and anticausal response of the damped cosines, edge repeated, normalised so that
    constants (order 0), ramps (1) and parabolas (2) come out exactly."""
    a0, a1, w0, b0, c0, c1, w1, b1 = DERICHE[order]
    n = np.arange(0, max(8, math.ceil(12 * sigma)))
    t = n / sigma
    half = (a0 * np.cos(w0 * t) + a1 * np.sin(w0 * t)) * np.exp(-b0 * t) + (c0 * np.cos(w1 * t) + c1 * np.sin(w1 * t)) * np.exp(-b1 * t)
    sign = -1 if order == 1 else 1
    full = np.concatenate((sign * half[:0:-1], half))
    k = np.arange(-len(half) + 1, len(half))
    if order == 1:
        full[len(half) - 1] = 0
        full = full / -(full * k).sum()
    elif order == 2:
        full = full - full.sum() / len(full)
        full = 2 * full / (full * k * k).sum()
    else:
        full = full / full.sum()
    return fir(full)


def recursive_gaussian(r: Raster, sigma: float, axis: str, order: int = 0) -> Raster:
    return along(r, axis, recursive_kernel(sigma / r.geometry.spacing[r.axes.index(axis)], order))


def smoothing_recursive_gaussian(r: Raster, sigma: float) -> Raster:
    for a in r.axes:
        r = recursive_gaussian(r, sigma, a)
    return r.map(lambda v: v, "float32")


def gradient_recursive_gaussian(r: Raster, sigma: float) -> Raster:
    """Gaussian derivatives along each axis as a vector pixel."""
    parts = []
    for a in r.axes:
        p = r
        for b in r.axes:
            p = recursive_gaussian(p, sigma, b, 1 if a == b else 0)
        parts.append(p)
    rows = parts[0].zip(*parts[1:])
    return Raster(rows.select(*r.keys, F.array(*[F.col(f"v{k}") for k in range(r.dim)]).alias("v")), r.geometry, PIXELS["float64"])


def gradient_magnitude_recursive_gaussian(r: Raster, sigma: float) -> Raster:
    from .pixelwise import vector_magnitude

    return vector_magnitude(gradient_recursive_gaussian(r, sigma))


def laplacian_recursive_gaussian(r: Raster, sigma: float) -> Raster:
    parts = []
    for a in r.axes:
        p = r
        for b in r.axes:
            p = recursive_gaussian(p, sigma, b, 2 if a == b else 0)
        parts.append(p)
    total = sum((F.col(f"v{k}") for k in range(1, r.dim)), F.col("v0"))
    return Raster(parts[0].zip(*parts[1:]).select(*r.keys, total.alias("v")), r.geometry, PIXELS["float64"])


# Distance maps


def _envelope(lines: np.ndarray, spacing: float) -> np.ndarray:
    """Lower envelope of parabolas, min over j of f(j) + (spacing (i - j))^2, for each line: one scan
    that keeps the parabolas of the envelope, one that reads it, both over all lines at once."""
    count, n = lines.shape
    every = np.arange(count)
    at = np.zeros((count, n), np.int64)  # the parabolas of the envelope so far
    low = np.full((count, n), -np.inf)  # from where each is lowest
    top = np.full(count, -1)
    where = np.arange(n) * spacing
    for q in range(n):
        open_ = np.isfinite(lines[:, q])
        begin = np.full(count, -np.inf)
        check = every[open_ & (top >= 0)]
        while len(check):
            p = at[check, top[check]]
            meet = ((lines[check, q] + where[q] ** 2) - (lines[check, p] + where[p] ** 2)) / (2 * (where[q] - where[p]))
            hidden = meet <= low[check, top[check]]
            begin[check] = np.where(hidden, -np.inf, meet)
            check = check[hidden]
            top[check] -= 1
            check = check[top[check] >= 0]
        top[open_] += 1
        rows = every[open_]
        at[rows, top[rows]] = q
        low[rows, top[rows]] = begin[rows]
    out, k = np.full_like(lines, np.inf), np.zeros(count, np.int64)
    some = every[top >= 0]
    for q in range(n):
        move = some
        while len(move := move[(k[move] < top[move]) & (low[move, np.minimum(k[move] + 1, n - 1)] < where[q])]):
            k[move] += 1
        p = at[some, k[some]]
        out[some, q] = lines[some, p] + (where[q] - where[p]) ** 2
    return out


def squared_distance_map(r: Raster, use_spacing: bool = True) -> Raster:
    """Squared distance of each voxel to the nearest voxel that is not zero (infinite without any)."""
    now = r.map(lambda v: F.when(v != 0, 0.0).otherwise(float("inf")), "float64")
    for a, s in zip(r.axes, r.geometry.spacing):
        h = s if use_spacing else 1.0
        now = along(now, a, lambda lines, h=h: _envelope(lines, h))
    return now


def signed_maurer_distance_map(r: Raster, squared: bool = False, inside_positive: bool = False, use_spacing: bool = True) -> Raster:
    """Distance to the object's contour voxels: negative inside unless ``inside_positive``."""
    from .morphology import binary_contour

    obj = r.map(lambda v: F.when(v != 0, 1).otherwise(0), "uint8")
    d = squared_distance_map(binary_contour(obj), use_spacing)
    size = F.col("v1") if squared else F.sqrt("v1")
    inside = F.col("v0") != 0
    value = F.when(inside, size if inside_positive else -size).otherwise(-size if inside_positive else size)
    return Raster(obj.zip(d).select(*r.keys, value.alias("v")), r.geometry, PIXELS["float64"])


def danielsson_distance_map(r: Raster, squared: bool = False, use_spacing: bool = False) -> Raster:
    """Distance of every voxel to the nearest one that is not zero (0 there), exact."""
    d = squared_distance_map(r, use_spacing)
    return d if squared else d.map(F.sqrt)


def signed_danielsson_distance_map(r: Raster, inside_positive: bool = False, squared: bool = False, use_spacing: bool = False) -> Raster:
    """Distance to the object minus distance to the rest grown by one voxel in its 3-box, so that the
    object's rim is 0 from both sides."""
    from .morphology import grayscale_dilate

    rest = grayscale_dilate(r.map(lambda v: F.when(v != 0, 0).otherwise(1), "uint8"), [1] * r.dim, "box")
    out, inside = danielsson_distance_map(r, squared, use_spacing), danielsson_distance_map(rest, squared, use_spacing)
    value = F.col("v1") - F.col("v0") if inside_positive else F.col("v0") - F.col("v1")
    return Raster(out.zip(inside).select(*r.keys, value.alias("v")), r.geometry, PIXELS["float64"])


def directed_hausdorff(a: Raster, b: Raster):
    """Largest and mean distance of a's object voxels to b's object: image_id, maximum, mean."""
    rows = a.zip(squared_distance_map(b)).where("v0 <> 0")
    d = F.sqrt("v1")
    return rows.groupBy("image_id").agg(F.max(d).alias("maximum"), F.avg(d).alias("mean"))


def hausdorff_distance(a: Raster, b: Raster):
    both = directed_hausdorff(a, b).union(directed_hausdorff(b, a))
    return both.groupBy("image_id").agg(F.max("maximum").alias("distance"), F.max("mean").alias("average"))


# Fourier transforms: complex lines as two interleaved halves


def _fft_axis(r: Raster, axis: str, inverse: bool) -> Raster:
    others = [a for a in r.axes if a != axis]
    part = lambda name: F.transform(F.array_sort(F.collect_list(F.struct(axis, F.col(f"v.{name}").alias("v")))), lambda s: s["v"]).alias(name)
    lines = r.df.groupBy("image_id", *others).agg(part("re"), part("im"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            re, im = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("re", "im"))
            out = (np.fft.ifft if inverse else np.fft.fft)(re + 1j * im, axis=1)
            offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            parts = {"re": out.real, "im": out.imag}
            cols = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(parts[c]).ravel())) if c in parts else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    done = lines.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in lines.dtypes))
    rows = done.select("image_id", *others, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "v"))
    return Raster(rows.select(*r.keys, "v"), r.geometry, PIXELS["float64"])


def forward_fft(r: Raster) -> Raster:
    """Discrete Fourier transform: pixels struct(re, im)."""
    now = Raster(r.df.select(*r.keys, F.struct(F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")).alias("v")), r.geometry, PIXELS["float64"])
    for a in r.axes:
        now = _fft_axis(now, a, False)
    return now


def inverse_fft(r: Raster) -> Raster:
    """Real part of the inverse transform."""
    for a in r.axes:
        r = _fft_axis(r, a, True)
    return Raster(r.df.select(*r.keys, F.col("v.re").alias("v")), r.geometry, PIXELS["float64"])


def half_hermitian_fft(r: Raster) -> tuple[Raster, bool]:
    """The half of a real raster's spectrum with x up to n // 2, and whether n is odd."""
    n, g = r.geometry.size[0], r.geometry
    half = forward_fft(r).df.where(F.col("x") <= n // 2)
    return Raster(half, replace(g, size=(n // 2 + 1, *g.size[1:])), PIXELS["float64"]), n % 2 == 1


def half_hermitian_inverse_fft(half: Raster, odd: bool) -> Raster:
    """The real raster of half a spectrum: the other half is its conjugate, mirrored on all axes."""
    g = half.geometry
    n = 2 * (g.size[0] - 1) + odd
    mirror = [(F.lit(n) - F.col("x")).cast("int").alias("x"), *[F.pmod(-F.col(a), F.lit(k)).cast("int").alias(a) for a, k in zip(half.axes[1:], g.size[1:])]]
    rest = half.df.where(F.col("x").between(1, (n - 1) // 2)).select("image_id", *mirror, F.struct(F.col("v.re").alias("re"), (-F.col("v.im")).alias("im")).alias("v"))
    return inverse_fft(Raster(half.df.unionByName(rest), replace(g, size=(n, *g.size[1:])), PIXELS["float64"]))


def smooth_size(n: int, greatest_prime: int = 5) -> int:
    """The least size from ``n`` on without a prime factor above ``greatest_prime``."""
    while True:
        rest = n
        for p in range(2, greatest_prime + 1):
            while rest % p == 0:
                rest //= p
        if rest <= 1:
            return n
        n += 1


def fft_pad(r: Raster, border: str = "zero_flux", greatest_prime: int = 5) -> Raster:
    """Padded on both sides (the odd voxel above) to sizes that transform fast; ``border`` is
    ``zero``, ``zero_flux`` or ``periodic``."""
    from .geometry import constant_pad, wrap_pad, zero_flux_pad

    more = [smooth_size(n, greatest_prime) - n for n in r.geometry.size]
    pad = {"zero": constant_pad, "zero_flux": zero_flux_pad, "periodic": wrap_pad}[border]
    return pad(r, [k // 2 for k in more], [k - k // 2 for k in more])


def fft_filter(r: Raster, response: Callable) -> Raster:
    """Multiply the spectrum by a real response of the frequency columns (cycles per voxel)."""
    spectrum = forward_fft(r)
    freq = [F.when(F.col(a) <= (n - 1) // 2, F.col(a)).otherwise(F.col(a) - n) / n for a, n in zip(r.axes, r.geometry.size)]
    h = response(*freq)
    scaled = spectrum.df.select(*r.keys, F.struct((F.col("v.re") * h).alias("re"), (F.col("v.im") * h).alias("im")).alias("v"))
    return inverse_fft(Raster(scaled, r.geometry, PIXELS["float64"]))
