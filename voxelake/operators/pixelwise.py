"""Operators on each voxel alone: arithmetic, logic, thresholds, complex and vector pixels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..raster import PIXELS, Raster

NAN, INF = float("nan"), float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with IEEE infinities and NaN on a zero divisor."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when(F.isnan(a) | F.isnan(b) | (a == 0), F.lit(NAN)).otherwise(F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))


def _log(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.when(v == 0, F.lit(-INF)).when((v < 0) | F.isnan(v), F.lit(NAN)).otherwise(fn(v))


#: Unary operators in double, narrowed to the pixel type.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "sin": F.sin, "tan": F.tan,
    "exp": F.exp, "exp_negative": lambda v: F.exp(-v), "log": _log(F.log), "log10": _log(F.log10), "sqrt": lambda v: F.when(v < 0, F.lit(NAN)).otherwise(F.sqrt(F.greatest(v, F.lit(0.0)))),
    "square": lambda v: v * v, "bounded_reciprocal": lambda v: ieee_div(F.lit(1.0), v + 1), "round": lambda v: F.floor(v + 0.5).cast("double"),
}

#: Binary operators in double, narrowed to the first raster's pixel type.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "squared_difference": lambda a, b: (a - b) * (a - b), "absolute_value_difference": lambda a, b: F.abs(a - b), "atan2": F.atan2,
    "binary_magnitude": lambda a, b: F.sqrt(a * a + b * b), "pow": F.pow, "divide_real": ieee_div, "maximum": F.greatest, "minimum": F.least,
}

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b,
}

BITS: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda a, b: a.bitwiseAND(b), "or": lambda a, b: a.bitwiseOR(b), "xor": lambda a, b: a.bitwiseXOR(b),
}


def unary(r: Raster, name: str) -> Raster:
    return r.map(lambda v: UNARY[name](v.cast("double")))


def binary(a: Raster, b: Raster, name: str) -> Raster:
    """One of BINARY by voxel; ``divide_real`` gives float64."""
    pixel = PIXELS["float64"] if name == "divide_real" else a.pixel
    value = BINARY[name](F.col("v0").cast("double"), F.col("v1").cast("double"))
    return a.with_rows(a.zip(b).withColumn("v", pixel.saturate(value)), pixel=pixel)


def compare(a: Raster, b: Raster, name: str, foreground: int = 1, background: int = 0) -> Raster:
    """1 where the comparison holds; a NaN on either side holds only for ``not_equal``."""
    rows = a.zip(b)
    unordered = F.isnan(F.col("v0").cast("double")) | F.isnan(F.col("v1").cast("double"))
    holds = F.when(unordered, F.lit(name == "not_equal")).otherwise(COMPARE[name](F.col("v0"), F.col("v1")))
    return a.with_rows(rows.withColumn("v", F.when(holds, foreground).otherwise(background)), pixel="uint8")


def bitwise(a: Raster, b: Raster, name: str) -> Raster:
    return a.with_rows(a.zip(b).withColumn("v", BITS[name](F.col("v0"), F.col("v1"))))


def add(a: Raster, b: Raster) -> Raster:
    return a + b


def subtract(a: Raster, b: Raster) -> Raster:
    return a - b


def multiply(a: Raster, b: Raster) -> Raster:
    return a * b


def divide(a: Raster, b: Raster) -> Raster:
    """Truncating for integers, and the type's largest value on a zero divisor."""
    rows = a.zip(b)
    if not a.pixel.integer:
        return a.with_rows(rows.withColumn("v", ieee_div(F.col("v0"), F.col("v1"))))
    top = F.lit(a.pixel.high).cast(a.pixel.exact)
    x, y = F.col("v0").cast(a.pixel.exact), F.col("v1").cast(a.pixel.exact)
    safe = F.when(y == 0, F.lit(1).cast(a.pixel.exact)).otherwise(y)
    quotient = (x - x % safe) / safe
    return a.with_rows(rows.withColumn("v", F.when(y == 0, top).otherwise(a.pixel.wrap(quotient.cast(a.pixel.exact)))))


def modulus(a: Raster, b: Raster) -> Raster:
    y = F.col("v1").cast(a.pixel.exact)
    rest = F.col("v0").cast(a.pixel.exact) % F.when(y == 0, F.lit(1).cast(a.pixel.exact)).otherwise(y)
    return a.with_rows(a.zip(b).withColumn("v", F.when(y == 0, F.lit(a.pixel.high).cast(a.pixel.exact)).otherwise(rest)))


def divide_floor(a: Raster, b: Raster) -> Raster:
    rows = a.zip(b)
    q = ieee_div(F.col("v0"), F.col("v1"))
    value = F.when(F.isnan(q) | (F.abs(q) == INF), q).otherwise(F.floor(F.when(F.isnan(q) | (F.abs(q) == INF), F.lit(0.0)).otherwise(q)).cast("double"))
    return a.with_rows(rows.withColumn("v", a.pixel.saturate(value)))


def constant(r: Raster, name: str, c: float) -> Raster:
    """``add``, ``subtract``, ``multiply`` or ``divide`` a constant in double, saturating."""
    ops = {"add": lambda v: v + c, "subtract": lambda v: v - c, "multiply": lambda v: v * c, "divide": lambda v: ieee_div(v, F.lit(float(c)))}
    return r.map(lambda v: ops[name](v.cast("double")))


def unary_minus(r: Raster) -> Raster:
    if r.pixel.integer and r.pixel.low == 0:
        raise ValueError("unary minus needs a signed pixel type")
    return -r


def cast(r: Raster, pixel: str) -> Raster:
    """Integers move exactly and saturate; reals truncate, NaN becomes 0."""
    p = PIXELS[pixel]
    if r.pixel.integer and p.integer:
        v = F.col("v").cast("decimal(38,0)")
        return r.with_rows(r.df.withColumn("v", F.least(F.greatest(v, F.lit(p.low).cast("decimal(38,0)")), F.lit(p.high).cast("decimal(38,0)"))), pixel=p)
    return r.map(lambda v: v, p)


def logical_not(r: Raster) -> Raster:
    return r.map(lambda v: F.when(v == 0, 1).otherwise(0))


def bitwise_not(r: Raster) -> Raster:
    return r.with_rows(r.df.withColumn("v", F.lit(r.pixel.high) - F.col("v") if r.pixel.low == 0 else -F.col("v") - 1))


def binary_not(r: Raster, foreground: float = 1, background: float = 0) -> Raster:
    return r.map(lambda v: F.when(v == foreground, background).otherwise(foreground))


def binary_threshold(r: Raster, lower: float, upper: float, inside: int = 1, outside: int = 0) -> Raster:
    return r.map(lambda v: F.when(v.between(lower, upper), inside).otherwise(outside), "uint8")


def threshold(r: Raster, lower: float, upper: float, outside: float = 0) -> Raster:
    return r.map(lambda v: F.when(v.between(lower, upper), v.cast("double")).otherwise(float(outside)))


def clamp(r: Raster, lower: float, upper: float, pixel: str | None = None) -> Raster:
    return r.map(lambda v: F.least(F.greatest(v.cast("double"), F.lit(float(lower))), F.lit(float(upper))), pixel)


def mask(r: Raster, mask_raster: Raster, outside: float = 0, masking: float = 0, negated: bool = False) -> Raster:
    """Keep values where the mask is not ``masking`` (``negated``: where it is)."""
    rows = r.zip(mask_raster)
    keep = (F.col("v1") == masking) if negated else (F.col("v1") != masking)
    return r.with_rows(rows.withColumn("v", F.when(keep, F.col("v0").cast("double")).otherwise(float(outside))))


def masked_assign(r: Raster, mask_raster: Raster, assign: Raster | float) -> Raster:
    """``assign`` where the mask is not zero."""
    if isinstance(assign, Raster):
        rows = r.zip(mask_raster, assign)
        return r.with_rows(rows.withColumn("v", F.when(F.col("v1") != 0, F.col("v2")).otherwise(F.col("v0"))))
    return r.with_rows(r.zip(mask_raster).withColumn("v", F.when(F.col("v1") != 0, r.pixel.saturate(F.lit(float(assign)))).otherwise(F.col("v0"))))


def _nary(rasters: list[Raster], agg: Callable[[Column], Column]) -> Raster:
    first = rasters[0]
    rows = reduce(lambda a, b: a.unionByName(b), [o.df.withColumn("v", F.col("v").cast("double")) for o in rasters])
    return first.with_rows(rows.groupBy(*first.keys).agg(agg(F.col("v")).alias("v")).withColumn("v", first.pixel.saturate(F.col("v"))))


def nary_add(rasters: list[Raster]) -> Raster:
    return _nary(rasters, F.sum)


def nary_maximum(rasters: list[Raster]) -> Raster:
    return _nary(rasters, F.max)


def ternary(a: Raster, b: Raster, c: Raster, name: str) -> Raster:
    """``add``, ``magnitude`` or ``magnitude_squared`` of three rasters."""
    x, y, z = (F.col(f"v{k}").cast("double") for k in range(3))
    value = {"add": x + y + z, "magnitude": F.sqrt(x * x + y * y + z * z), "magnitude_squared": x * x + y * y + z * z}[name]
    return a.with_rows(a.zip(b, c).withColumn("v", a.pixel.saturate(value)))


def sigmoid(r: Raster, alpha: float = 1, beta: float = 0, low: float = 0, high: float = 255) -> Raster:
    return r.map(lambda v: (high - low) / (1 + F.exp(-(v.cast("double") - beta) / alpha)) + low)


def intensity_windowing(r: Raster, window_low: float, window_high: float, low: float, high: float) -> Raster:
    scale = (high - low) / (window_high - window_low)
    return r.map(lambda v: F.when(v < window_low, low).when(v > window_high, high).otherwise((v.cast("double") - window_low) * scale + low))


def invert_intensity(r: Raster, maximum: float = 255) -> Raster:
    return r.map(lambda v: maximum - v.cast("double"))


def shift_scale(r: Raster, shift: float, scale: float, pixel: str | None = None) -> Raster:
    return r.map(lambda v: (v.cast("double") + shift) * scale, pixel)


def change_label(r: Raster, changes: dict[float, float]) -> Raster:
    """Values replaced by a map that is stated in the query."""
    value = F.col("v").cast("double")
    for old, new in changes.items():
        value = F.when(F.col("v") == old, float(new)).otherwise(value)
    return r.map(value)


def compose(rasters: list[Raster]) -> Raster:
    """Scalar rasters as the components of one raster of arrays."""
    first = rasters[0]
    rows = first.zip(*rasters[1:])
    return Raster(rows.select(*first.keys, F.array(*[F.col(f"v{k}") for k in range(len(rasters))]).alias("v")), first.geometry, first.pixel)


def component(r: Raster, index: int) -> Raster:
    return Raster(r.df.withColumn("v", F.element_at("v", index + 1)), r.geometry, r.pixel)


def vector_magnitude(r: Raster) -> Raster:
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return Raster(r.df.select(*r.keys, norm.alias("v")), r.geometry, PIXELS["float64"])


def edge_potential(r: Raster) -> Raster:
    return vector_magnitude(r).map(lambda v: F.exp(-v))


def to_complex(real: Raster, imaginary: Raster, polar: bool = False) -> Raster:
    """Pixels as struct(re, im) from two rasters (``polar``: from magnitude and phase)."""
    rows = real.zip(imaginary)
    a, b = F.col("v0").cast("double"), F.col("v1").cast("double")
    pair = F.struct((a * F.cos(b)).alias("re"), (a * F.sin(b)).alias("im")) if polar else F.struct(a.alias("re"), b.alias("im"))
    return Raster(rows.select(*real.keys, pair.alias("v")), real.geometry, PIXELS["float64"])


def complex_part(r: Raster, name: str) -> Raster:
    """``real``, ``imaginary``, ``modulus`` or ``phase`` of complex pixels."""
    re, im = F.col("v.re"), F.col("v.im")
    value = {"real": re, "imaginary": im, "modulus": F.hypot(re, im), "phase": F.atan2(im, re)}[name]
    return Raster(r.df.select(*r.keys, value.alias("v")), r.geometry, PIXELS["float64"])


def label_to_rgb(r: Raster, palette: list[tuple[int, int, int]], background: float = 0) -> Raster:
    """Palette colours by label modulo the palette's length; the background is black."""
    colours = F.array(*[F.array(*[F.lit(c) for c in rgb]) for rgb in palette])
    rgb = F.element_at(colours, F.pmod(F.col("v"), F.lit(len(palette))).cast("int") + 1)
    return Raster(r.df.select(*r.keys, F.when(F.col("v") == background, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(rgb).alias("v")), r.geometry, PIXELS["uint8"])


def _ramp(low: float, high: float) -> Callable[[Column], Column]:
    return lambda t: F.lit(low) + (high - low) * t


#: Colour maps on [0, 1]: red, green and blue, held in [0, 1].
COLORMAPS: dict[str, tuple[Callable[[Column], Column], ...]] = {
    "grey": (_ramp(0, 1),) * 3, "red": (_ramp(0, 1), _ramp(0, 0), _ramp(0, 0)), "green": (_ramp(0, 0), _ramp(0, 1), _ramp(0, 0)), "blue": (_ramp(0, 0), _ramp(0, 0), _ramp(0, 1)),
    "hot": (lambda t: t * 63 / 26 - 1 / 13, lambda t: t * 63 / 26 - 11 / 13, lambda t: t * 4.5 - 3.5), "cool": (_ramp(0, 1), _ramp(1, 0), _ramp(1, 1)),
    "spring": (_ramp(1, 1), _ramp(0, 1), _ramp(1, 0)), "summer": (_ramp(0, 1), lambda t: t * 0.5 + 0.5, _ramp(0.4, 0.4)), "autumn": (_ramp(1, 1), _ramp(0, 1), _ramp(0, 0)),
    "winter": (_ramp(0, 0), _ramp(0, 1), lambda t: 1 - t * 0.5), "copper": (lambda t: t * 1.2, lambda t: t * 0.8, lambda t: t * 0.5),
    "jet": (lambda t: 1.5 - F.abs(t * 3.95 - 2.9625), lambda t: 1.5 - F.abs(t * 3.95 - 1.975), lambda t: 1.5 - F.abs(t * 3.95 - 0.9875)),
}


def scalar_to_rgb(r: Raster, colormap: str = "grey") -> Raster:
    """Colours of the values between the image's extremes, as arrays of three bytes."""
    ends = r.df.groupBy("image_id").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    t = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("v").cast("double") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    byte = lambda f: F.floor(F.least(F.greatest(f(t), F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("smallint")
    rows = r.df.join(ends, "image_id").select(*r.keys, F.array(*[byte(f) for f in COLORMAPS[colormap]]).alias("v"))
    return Raster(rows, r.geometry, PIXELS["uint8"])


def label_overlay(r: Raster, labels: Raster, palette: list[tuple[int, int, int]], opacity: float = 0.5, background: float = 0) -> Raster:
    """Grey values blended with the palette colour of their label; the background stays grey."""
    rows = r.zip(labels)
    colours = F.array(*[F.array(*[F.lit(float(c)) for c in rgb]) for rgb in palette])
    rgb = F.element_at(colours, F.pmod(F.col("v1"), F.lit(len(palette))).cast("int") + 1)
    grey = F.col("v0").cast("double")
    mixed = F.transform(rgb, lambda c: F.floor(c * opacity + grey * (1 - opacity)))
    value = F.when(F.col("v1") == background, F.array(*[F.floor(grey)] * 3)).otherwise(mixed)
    return Raster(rows.select(*r.keys, value.alias("v")), r.geometry, PIXELS["uint8"])
