"""N4 bias correction: a smooth multiplicative field found by sharpening the histogram of logarithms.

A round sharpens the histogram of the corrected logarithms by deconvolution, fits a B-spline to
what the sharpened values leave, and adds it to the field; between levels the lattice is halved.
Voxels are staged once.  A round is three aggregates over them: range and convergence, the
histogram, and numerator and denominator of every control; tasks work out the field from the
lattice, which the driver holds.  Each image has its own lattice, histogram and end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import PIXELS, Raster
from ..staging import staged
from .alignment import CHUNK, add_sums
from .parametric import MOST_CONTROLS

#: Voxels worked on at once.
VOXELS = 1 << 14


def basis(t: np.ndarray, order: int) -> np.ndarray:
    """Values at ``t`` (0 to 1) of the order + 1 uniform B-splines that are not zero there."""
    out = [np.ones_like(t)]
    for q in range(1, order + 1):
        kept, new = np.zeros_like(t), []
        for k, w in enumerate(out):
            part = w / q
            new.append(kept + (k + 1 - t) * part)
            kept = (t + q - k - 1) * part
        out = [*new, kept]
    return np.stack(out, -1)


def support(index: np.ndarray, size: Sequence[int], controls: Sequence[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the controls of each voxel; the lattice spans the grid, first to last voxel."""
    flat, weight, stride = np.zeros((len(index), 1), np.int64), np.ones((len(index), 1)), 1
    for k, (n, c) in enumerate(zip(size, controls)):
        spans = c - order
        step = spans / (n - 1)
        u = index[:, k] * step
        u = np.where(np.abs(u - spans) <= step * 1e-3, spans - step * 1e-3, u)
        base = np.floor(u)
        w = basis(u - base, order)
        at = (base.astype(np.int64)[:, None] + np.arange(order + 1)) * stride
        flat = (flat[:, None, :] + at[:, :, None]).reshape(len(index), (order + 1) ** (k + 1))
        weight = (weight[:, None, :] * w[:, :, None]).reshape(len(index), (order + 1) ** (k + 1))
        stride *= c
    return flat, weight


def refined(lattice: np.ndarray, controls: Sequence[int], order: int) -> tuple[np.ndarray, list[int]]:
    """The same spline on a lattice of half the spacing."""
    out = lattice.reshape(list(reversed(controls)))
    for k, c in enumerate(controls):
        n = 2 * (c - order) + order
        halve = np.zeros((n, c))
        for j in range(n):
            for i in range(c):
                if 0 <= j - 2 * i + order <= order + 1:
                    halve[j, i] = math.comb(order + 1, j - 2 * i + order) / 2**order
        axis = len(controls) - 1 - k
        out = np.moveaxis(np.tensordot(halve, out, (1, axis)), 0, axis)
    return out.ravel(), [2 * (c - order) + order for c in controls]


def sharpened(histogram: np.ndarray, low: float, slope: float, width: float, noise: float) -> np.ndarray:
    """The expected true value of each bin: a Gaussian of full width ``width`` at half its height is
    taken out of the histogram by a Wiener filter."""
    bins = len(histogram)
    # the exponent comes from a logarithm of 32 bits, so powers of two are padded once more
    size = round(2 ** (math.ceil(float(np.log(np.float32(bins))) / math.log(2)) + 1))
    first = (size - bins) // 2
    padded = np.zeros(size)
    padded[first : first + bins] = histogram
    scaled = width / slope
    away = np.minimum(np.arange(size), size - np.arange(size))
    blur = np.fft.fft(2 * math.sqrt(math.log(2) / math.pi) / scaled * np.exp(-(away**2) * 4 * math.log(2) / scaled**2))
    wiener = (np.conj(blur) / (np.conj(blur) * blur + noise)).real
    true = np.maximum(np.fft.ifft(np.fft.fft(padded) * wiener).real, 0)
    place = low + (np.arange(size) - first) * slope
    above, below = (np.fft.ifft(np.fft.fft(x) * blur).real for x in (place * true, true))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(below != 0, above / below, 0.0)[first : first + bins]


@dataclass
class _State:
    """What the tasks need to know of one image."""

    controls: list[int]
    lattice: np.ndarray
    before: np.ndarray
    low: float = 0.0
    slope: float = 0.0
    expected: np.ndarray | None = None

    def positions(self, u: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins of values, the part of a bin they lie beyond its start, and which have one."""
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (u - self.low) / self.slope
            good = np.isfinite(at) & (at >= 0) & (np.floor(at) < bins)
        at = np.where(good, at, 0)
        return np.floor(at).astype(np.int64), at - np.floor(at), good


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, key = None, None
    for b in batches:
        for row in b.to_pylist():
            v = np.frombuffer(row["sums"])
            total, key = v if total is None else np.maximum(v, total), row
    yield pa.RecordBatch.from_arrays([pa.array([key["image_id"]]), pa.array([key["chunk"]], pa.int32()), pa.array([total.tobytes()])], names=["image_id", "chunk", "sums"])


#: The steps of a round: what each sums over the voxels, of (state, corrected value, field, field before, weight, controls, weights of controls).
def _range(state, u, field, before, w, flat, t) -> np.ndarray:
    return np.array([u.max(), -u.min()])


def _change(state, u, field, before, w, flat, t) -> np.ndarray:
    ratio = np.exp(before - field) - 1
    return np.array([len(u), ratio.sum(), (ratio * ratio).sum()])


def _histogram(bins: int):
    def histogram(state, u, field, before, w, flat, t) -> np.ndarray:
        k, part, good = state.positions(u, bins)
        good &= (part == 0) | (k < bins - 1)
        k, part = k[good], part[good]
        return np.bincount(k, 1 - part, bins + 1)[:bins] + np.bincount(k + 1, part, bins + 1)[:bins]

    return histogram


def _fit(bins: int):
    """Numerators and denominators of the controls: a voxel asks of each control in its support for
    what, by least squares, would give the voxel's value alone, and counts by its weight squared."""

    def fit(state, u, field, before, w, flat, t) -> np.ndarray:
        k, part, good = state.positions(u, bins)
        e = np.append(state.expected, state.expected[-1])
        left = u - np.where(good, e[k] + (e[k + 1] - e[k]) * part, 0.0)
        square = t * t
        asked = square * t * (left / square.sum(1))[:, None]
        n = len(state.lattice)
        return np.concatenate((np.bincount(flat.ravel(), (asked * w[:, None]).ravel(), n), np.bincount(flat.ravel(), (square * w[:, None]).ravel(), n)))

    return fit


def _pass(voxels: DataFrame, states: dict[int, _State], size: Sequence[int], axes: Sequence[str], order: int, step: Callable) -> dict[int, np.ndarray]:
    """A step of a round over the voxels of the open images, summed (ranges: the largest) by image."""
    sent = voxels.sparkSession.sparkContext.broadcast(states)
    join = np.maximum if step is _range else np.add

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, VOXELS):
                b = whole.slice(start, VOXELS)
                image, v, w = (b.column(c).to_numpy() for c in ("image_id", "v", "w"))
                index = np.stack([b.column(a).to_numpy() for a in axes], 1)
                for i in np.unique(image).tolist():
                    state = sent.value.get(i)
                    if state is not None:
                        mine = image == i
                        flat, t = support(index[mine], size, state.controls, order)
                        field, before = ((t * x[flat]).sum(1) for x in (state.lattice, state.before))
                        new = step(state, v[mine] - field, field, before, w[mine], flat, t)
                        total[i] = new if i not in total else join(total[i], new)
        for i, x in total.items():
            for c in range(0, len(x), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([c // CHUNK], pa.int32()), pa.array([x[c : c + CHUNK].tobytes()])], names=["image_id", "chunk", "sums"])

    kinds = "image_id long, chunk int, sums binary"
    rows = voxels.mapInArrow(run, kinds).groupBy("image_id", "chunk").applyInArrow(_largest if step is _range else add_sums, kinds)
    out: dict[int, list] = {}
    for r in rows.collect():
        out.setdefault(r.image_id, []).append((r.chunk, np.frombuffer(r.sums)))
    return {i: np.concatenate([x for _, x in sorted(parts, key=lambda p: p[0])]) for i, parts in out.items()}


def n4_bias_field(
    r: Raster, mask: Raster | None = None, confidence: Raster | None = None, levels: Sequence[int] = (50, 50, 50, 50), threshold: float = 0.001,
    width: float = 0.15, noise: float = 0.01, bins: int = 200, controls: Sequence[int] = (4, 4, 4), order: int = 3, mask_label: int | None = 1,
) -> tuple[Raster, Raster]:
    """The raster divided by its bias, and the logarithm of the bias.

    The bias is judged on voxels whose mask is ``mask_label`` (None: not 0) and whose confidence,
    the weight of the fit, is above 0; voxels that are not positive enter as they are.  ``levels``
    gives the most rounds of each level; a level ends when the spread of the ratio of successive
    fields is at most ``threshold`` of its mean.  Images without such voxels have bias 1; an image
    of one value has no histogram, and all of it counts as bias.
    """
    if r.pixel.integer:
        raise ValueError("N4 takes real pixels")
    if bins < 2 or order < 1 or not levels or min(levels) < 1 or len(controls) < r.dim or any(c < order + 1 for c in controls[: r.dim]) or min(r.geometry.size) < 2:
        raise ValueError("N4 needs two bins, a spline order of 1, a round for each level, order + 1 controls and two voxels on each axis")
    size, controls = r.geometry.size, list(controls[: r.dim])
    if math.prod(2 ** (len(levels) - 1) * (c - order) + order for c in controls) > MOST_CONTROLS:
        raise ValueError(f"a lattice holds at most {MOST_CONTROLS} control values")
    rows = r.df.select(*r.keys, F.col("v").cast("double").alias("v"))
    if mask is not None:
        rows = rows.join(mask.df.where("v <> 0" if mask_label is None else F.col("v") == mask_label).select(*r.keys), r.keys, "left_semi")
    if confidence is not None:
        rows = rows.join(confidence.df.where("v > 0").select(*r.keys, F.col("v").cast("double").alias("w")), r.keys)
    weight = F.col("w") if confidence is not None else F.lit(1.0)
    voxels = staged(rows.select(*r.keys, F.when(F.col("v") > 0, F.log("v")).otherwise(F.col("v")).alias("v"), weight.alias("w")))
    zero = np.zeros(math.prod(controls))
    states = {x.image_id: _State(controls, zero, zero) for x in voxels.select("image_id").distinct().collect()}
    over = lambda live, step: _pass(voxels, {i: states[i] for i in live}, size, r.axes, order, step)
    for level, most in enumerate(levels):
        live = set(states)
        for _ in range(most):
            for i, (high, low) in over(live, _range).items():
                states[i].low, states[i].slope = -low, (high + low) / (bins - 1)
            for i, counts in over(live, _histogram(bins)).items():
                s = states[i]
                s.expected = sharpened(counts, s.low, s.slope, width, noise) if s.slope > 0 else np.zeros(bins)
            for i, sums in over(live, _fit(bins)).items():
                above, below = sums.reshape(2, -1)
                s = states[i]
                s.before, s.lattice = s.lattice, s.lattice + np.divide(above, below, out=np.zeros_like(above), where=below != 0)
            for i, (n, first, second) in over(live, _change).items():
                spread = math.sqrt(max(second - first * first / n, 0) / max(n - 1, 1)) / (1 + first / n)
                if not spread > threshold:
                    live.discard(i)
            if not live:
                break
        if level + 1 < len(levels):
            for s in states.values():
                s.lattice, s.controls = refined(s.lattice, s.controls, order)
                s.before = s.lattice
    return _divided(r, states, order)


def _divided(r: Raster, states: dict[int, _State], order: int) -> tuple[Raster, Raster]:
    """The raster over the exponential of its field, and the field, at every voxel."""
    sent, axes, size = r.df.sparkSession.sparkContext.broadcast(states), r.axes, r.geometry.size

    def field(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, VOXELS):
                b = whole.slice(start, VOXELS)
                image, out = b.column("image_id").to_numpy(), np.zeros(b.num_rows)
                index = np.stack([b.column(a).to_numpy() for a in axes], 1)
                for i in np.unique(image).tolist():
                    if i in sent.value:
                        mine = image == i
                        flat, t = support(index[mine], size, sent.value[i].controls, order)
                        out[mine] = (t * sent.value[i].lattice[flat]).sum(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "field"])

    kinds = reduce(lambda s, f: f"{s}, {f.name} {f.dataType.simpleString()}", r.df.schema.fields, "")[2:]
    rows = r.df.mapInArrow(field, f"{kinds}, field double")
    real = lambda c: r.with_rows(rows.withColumn("v", c), pixel=r.pixel)
    return real(F.col("v").cast("double") / F.exp("field")), Raster(rows.select(*r.keys, F.col("field").alias("v")), r.geometry, PIXELS["float64"])
