"""Queries of pixelwise operators, reductions and index remaps.

Each entry is a query over rasters of the driver tables and its SQL.  Cells come out as
x, y, v with v rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..operators import pixelwise as px
from ..operators import reduce as red
from ..raster import Raster
from ..sources import tables

#: Cells of the month by supplier grid: quantity v, rows c, sum of line numbers d.
CELLS = """
WITH g AS (SELECT x, y FROM (SELECT unnest(range(12)) AS x) a, (SELECT unnest(range((SELECT max(s_suppkey) + 1 FROM supplier))) AS y) b),
s AS (SELECT month(l_shipdate) - 1 AS x, l_suppkey AS y, sum(l_quantity) AS v, count(*) AS c, sum(l_linenumber) AS d FROM lineitem GROUP BY 1, 2),
q AS (SELECT g.x, g.y, CAST(coalesce(s.v, 0) AS BIGINT) AS v, CAST(coalesce(s.c, 0) AS BIGINT) AS c, CAST(coalesce(s.d, 0) AS BIGINT) AS d
  FROM g LEFT JOIN s USING (x, y))"""


def cells(r: Raster) -> DataFrame:
    """x, y, v of a raster for comparison; v as double, six decimals, zero without a sign."""
    return r.df.select(*[F.col(a).cast("long").alias(a) for a in r.axes], (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("v"))


def cells_sql(value: str, source: str = "q", where: str = "") -> str:
    return f"{CELLS}\nSELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(CAST({value} AS DOUBLE), 6) + 0.0 AS v FROM {source} {where}"


def quantity(spark: SparkSession, sf_dir: str, pixel: str = "int32") -> Raster:
    return tables.by_month(spark, sf_dir, "sum(l_quantity)", pixel)


def rows(spark: SparkSession, sf_dir: str, pixel: str = "int32") -> Raster:
    return tables.by_month(spark, sf_dir, "count(1)", pixel)


def lines(spark: SparkSession, sf_dir: str, pixel: str = "int32") -> Raster:
    return tables.by_month(spark, sf_dir, "sum(l_linenumber)", pixel)


def real(spark: SparkSession, sf_dir: str) -> Raster:
    return quantity(spark, sf_dir, "float64")


def unit(spark: SparkSession, sf_dir: str) -> Raster:
    """Quantities as reals between -1 and 1."""
    return real(spark, sf_dir).map(lambda v: (v % 97) / 50 - 0.95)


UNIT = "((v % 97) / 50.0::DOUBLE - 0.95::DOUBLE)"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def one(name: str, fn: Callable[[Raster], Raster], sql: str, source: Callable = quantity) -> None:
    QUERIES[name] = (lambda s, d: cells(fn(source(s, d))), cells_sql(sql))


def two(name: str, fn: Callable[[Raster, Raster], Raster], sql: str, pixel: str = "int32") -> None:
    QUERIES[name] = (lambda s, d: cells(fn(quantity(s, d, pixel), rows(s, d, pixel))), cells_sql(sql))


def table(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = (query, sql)


# Unary operators on reals
UNARY_SQL = {
    "abs": "abs({u})", "acos": "acos({u} / 1.1)", "asin": "asin({u} / 1.1)", "atan": "atan({u})", "cos": "cos({u})", "sin": "sin({u})", "tan": "tan({u})", "exp": "exp({u})",
    "exp_negative": "exp(-{u})", "log": "ln(v + 1)", "log10": "log10(v + 1)", "sqrt": "sqrt(v)", "square": "{u} * {u}", "bounded_reciprocal": "1.0 / (1 + {u})", "round": "floor({u} * 10 + 0.5)",
}
SHIFTED = {"acos": lambda v: v / 1.1, "asin": lambda v: v / 1.1, "round": lambda v: v * 10}
for _name, _sql in UNARY_SQL.items():
    if _name in ("log", "log10"):
        one(_name, lambda r, n=_name: px.unary(r.map(lambda v: v + 1), n), _sql, real)
    elif _name == "sqrt":
        one(_name, lambda r, n=_name: px.unary(r, n), _sql, real)
    else:
        one(_name, lambda r, n=_name: px.unary(r.map(SHIFTED.get(n, lambda v: v)), n), _sql.format(u=UNIT), unit)

# Binary operators
for _name, _sql in {
    "squared_difference": "(v - c) * (v - c)", "absolute_value_difference": "abs(v - c)", "atan2": "atan2(v, c)", "binary_magnitude": "sqrt(v * v + c * c)",
    "divide_real": "CASE WHEN c <> 0 THEN v / CAST(c AS DOUBLE) WHEN v = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END", "maximum": "greatest(v, c)", "minimum": "least(v, c)",
}.items():
    two(_name, lambda a, b, n=_name: px.binary(a, b, n), _sql, "float64")
two("pow", lambda a, b: px.binary(a.map(lambda v: v / 1000), b.map(lambda v: v / 100), "pow"), "pow(v / 1000.0::DOUBLE, c / 100.0::DOUBLE)", "float64")
for _name, _op in {"greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<=", "equal": "=", "not_equal": "<>"}.items():
    two(_name, lambda a, b, n=_name: px.compare(a.map(lambda v: v % 60), b, n), f"CASE WHEN v % 60 {_op} c THEN 1 ELSE 0 END")
for _name, _sql in {"and": "v & c", "or": "v | c", "xor": "xor(v, c)"}.items():
    two(_name, lambda a, b, n=_name: px.bitwise(a, b, n), _sql)
two("add", px.add, "v + c")
two("subtract", lambda a, b: px.subtract(b, a), "c - v")
two("multiply", px.multiply, "v * c")
two("add_wraps_uint8", lambda a, b: px.add(a.map(lambda v: v % 256, "uint8"), b.map(lambda v: v, "uint8")), "(v % 256 + c) % 256")
two("divide", px.divide, "CASE WHEN c = 0 THEN 2147483647 ELSE v // c END")
two("modulus", px.modulus, "CASE WHEN c = 0 THEN 2147483647 ELSE v % c END")
two("divide_floor", px.divide_floor, "CASE WHEN c <> 0 THEN floor(v / CAST(c AS DOUBLE)) WHEN v = 0 THEN 0 ELSE 2147483647 END")
for _name, _sql in {"add": "v + 2.5", "subtract": "v - 2.5", "multiply": "v * 2.5", "divide": "v / 2.5"}.items():
    one(f"{_name}_constant", lambda r, n=_name: px.constant(r, n, 2.5), f"trunc({_sql})")
one("unary_minus", px.unary_minus, "-v")
one("cast_uint8_saturates", lambda r: px.cast(r, "uint8"), "least(v, 255)")
one("cast_real_truncates", lambda r: px.cast(r.map(lambda v: v / 7 - 100), "int16"), "trunc(v / 7.0::DOUBLE - 100)", real)
one("not", px.logical_not, "CASE WHEN v = 0 THEN 1 ELSE 0 END")
one("bitwise_not", px.bitwise_not, "-v - 1")
one("binary_not", lambda r: px.binary_not(r.map(lambda v: v % 3), 1, 0), "CASE WHEN v % 3 = 1 THEN 0 ELSE 1 END")
one("binary_threshold", lambda r: px.binary_threshold(r, 1200, 1400, 1, 0), "CASE WHEN v BETWEEN 1200 AND 1400 THEN 1 ELSE 0 END")
one("threshold", lambda r: px.threshold(r, 1200, 1400, 7), "CASE WHEN v BETWEEN 1200 AND 1400 THEN v ELSE 7 END")
one("clamp", lambda r: px.clamp(r, 1200, 1400), "least(greatest(v, 1200), 1400)")
two("mask", lambda a, b: px.mask(a, b.map(lambda v: v % 2), 5), "CASE WHEN c % 2 <> 0 THEN v ELSE 5 END")
two("mask_negated", lambda a, b: px.mask(a, b.map(lambda v: v % 2), 5, 0, True), "CASE WHEN c % 2 = 0 THEN v ELSE 5 END")
two("masked_assign", lambda a, b: px.masked_assign(a, b.map(lambda v: v % 2), b), "CASE WHEN c % 2 <> 0 THEN c ELSE v END")
two("masked_assign_constant", lambda a, b: px.masked_assign(a, b.map(lambda v: v % 2), 9), "CASE WHEN c % 2 <> 0 THEN 9 ELSE v END")
table("nary_add", lambda s, d: cells(px.nary_add([quantity(s, d), rows(s, d), lines(s, d)])), cells_sql("v + c + d"))
table("nary_maximum", lambda s, d: cells(px.nary_maximum([quantity(s, d), rows(s, d), lines(s, d)])), cells_sql("greatest(v, c, d)"))
for _name, _sql in {"add": "v + c + d", "magnitude": "trunc(sqrt(v * v + c * c + d * d))", "magnitude_squared": "v * v + c * c + d * d"}.items():
    table(f"ternary_{_name}", lambda s, d, n=_name: cells(px.ternary(quantity(s, d), rows(s, d), lines(s, d), n)), cells_sql(_sql))
one("sigmoid", lambda r: px.sigmoid(r, 100, 1275, 0, 255), "255 / (1 + exp(-(v - 1275) / 100.0::DOUBLE))", real)
one("intensity_windowing", lambda r: px.intensity_windowing(r, 1100, 1500, 0, 255), "CASE WHEN v < 1100 THEN 0 WHEN v > 1500 THEN 255 ELSE (v - 1100) * (255 / 400.0::DOUBLE) END", real)
one("invert_intensity", lambda r: px.invert_intensity(r, 3000), "3000 - v")
one("shift_scale", lambda r: px.shift_scale(r, 5, 0.5), "trunc((v + 5) * 0.5)")
one("change_label", lambda r: px.change_label(r.map(lambda v: v % 5), {1: 10, 3: 30}), "CASE v % 5 WHEN 1 THEN 10 WHEN 3 THEN 30 ELSE v % 5 END")
two("vector_magnitude", lambda a, b: px.vector_magnitude(px.compose([a, b])), "sqrt(CAST(v * v + c * c AS DOUBLE))")
two("vector_index_selection_cast", lambda a, b: px.component(px.compose([a, b]), 1), "c")
two("edge_potential", lambda a, b: px.edge_potential(px.compose([a.map(lambda v: v / 1000), b.map(lambda v: v / 100)])), "exp(-sqrt(pow(v / 1000.0::DOUBLE, 2) + pow(c / 100.0::DOUBLE, 2)))", "float64")
for _name, _sql in {"real": "v", "imaginary": "c", "modulus": "sqrt(CAST(v * v + c * c AS DOUBLE))", "phase": "atan2(c, v)"}.items():
    two(f"complex_to_{_name}", lambda a, b, n=_name: px.complex_part(px.to_complex(a, b), n), _sql)
two("magnitude_and_phase_to_complex", lambda a, b: px.complex_part(px.to_complex(a, b, polar=True), "imaginary"), "v * sin(c)")
one("label_to_rgb", lambda r: px.component(px.label_to_rgb(r.map(lambda v: v % 4), [(255, 0, 0), (0, 205, 0), (0, 0, 255)]), 0), "CASE WHEN v % 4 IN (3) THEN 255 ELSE 0 END")

# Reductions
STATS = "min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_samp(v) AS sigma, sum(v) AS total"
WITH_STATS = f"(SELECT q.*, s.* FROM q, (SELECT {STATS} FROM q) s)"
table("statistics", lambda s, d: red.statistics(quantity(s, d)).select("minimum", "maximum", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("sigma", 6).alias("sigma"), "sum", "count"),
      CELLS + " SELECT CAST(min(v) AS DOUBLE) AS minimum, CAST(max(v) AS DOUBLE) AS maximum, round(avg(v), 6) AS mean, round(var_samp(v), 4) AS variance, round(stddev_samp(v), 6) AS sigma, CAST(sum(v) AS DOUBLE) AS sum, count(*) AS count FROM q")
table("minimum_maximum", lambda s, d: red.minimum_maximum(quantity(s, d)).select(F.col("minimum").cast("long").alias("minimum"), F.col("maximum").cast("long").alias("maximum")), CELLS + " SELECT min(v) AS minimum, max(v) AS maximum FROM q")
QUERIES["rescale_intensity"] = (lambda s, d: cells(red.rescale_intensity(real(s, d), 0, 255)), cells_sql("(v - lo) * (255 / CAST(hi - lo AS DOUBLE))", WITH_STATS))
QUERIES["normalize"] = (lambda s, d: cells(red.normalize(real(s, d))), cells_sql("(v - mean) / sigma", WITH_STATS))
QUERIES["normalize_to_constant"] = (lambda s, d: cells(red.normalize_to_constant(real(s, d), 1000)), cells_sql("v / (total / 1000.0::DOUBLE)", WITH_STATS))
table("shift_scale_counts", lambda s, d: red.shift_scale_counts(quantity(s, d, "int16"), 0, 25).select("underflow", "overflow"), CELLS + " SELECT count(*) FILTER (v * 25 < -32768) AS underflow, count(*) FILTER (v * 25 > 32767) AS overflow FROM q")
for _axis, _keep in (("x", "y"), ("y", "x")):
    for _name, _sql in {"mean": "avg(v)", "sum": "sum(v)", "maximum": "max(v)", "minimum": "min(v)", "median": "list_sort(list(v))[count(*) // 2 + 1]", "standard_deviation": "stddev_samp(v)"}.items():
        table(f"{_name}_projection_{_axis}", lambda s, d, n=_name, a=_axis: cells(red.projection(quantity(s, d), a, n)),
              CELLS + f" SELECT CAST({'0' if _axis == 'x' else 'x'} AS BIGINT) AS x, CAST({'0' if _axis == 'y' else 'y'} AS BIGINT) AS y, round(CAST({_sql} AS DOUBLE), 6) AS v FROM q GROUP BY {_keep}")
table("binary_projection", lambda s, d: cells(red.binary_projection(px.binary_threshold(quantity(s, d), 1500, 1e9), "x")), CELLS + " SELECT CAST(0 AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(max(CASE WHEN v >= 1500 THEN 1 ELSE 0 END) AS DOUBLE) AS v FROM q GROUP BY y")
table("binary_threshold_projection", lambda s, d: cells(red.binary_threshold_projection(quantity(s, d), "x", 1500)), CELLS + " SELECT CAST(0 AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(max(CASE WHEN v >= 1500 THEN 1 ELSE 0 END) AS DOUBLE) AS v FROM q GROUP BY y")
EDGES = """, e AS (SELECT lo, hi + (hi - lo) / 64.0::DOUBLE / 100 AS top FROM (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM q)),
bins AS (SELECT k, lo + k * ((top - lo) / 64) AS a, CASE WHEN k = 63 THEN top ELSE lo + (k + 1) * ((top - lo) / 64) END AS b FROM e, (SELECT unnest(range(64)) AS k)),
h AS (SELECT k, a, b, count(q.v) AS f FROM bins LEFT JOIN q ON q.v >= a AND (q.v < b) GROUP BY k, a, b)"""
table("histogram", lambda s, d: red.histogram(quantity(s, d), 64).select(F.col("bin").cast("long").alias("bin"), "count"), CELLS + EDGES + " SELECT CAST(k AS BIGINT) AS bin, f AS count FROM h")
OTSU = """, c AS (SELECT k, b, sum(f) OVER w AS n1, sum(f * (a + b) / 2) OVER w AS m1, sum(f) OVER () AS n, sum(f * (a + b) / 2) OVER () AS m FROM h WINDOW w AS (ORDER BY k)),
t AS (SELECT b FROM c WHERE n1 > 0 AND n1 < n ORDER BY round(m1 * m1 / n1 + (m - m1) * (m - m1) / (n - n1), 6) DESC, k LIMIT 1)"""
table("otsu_threshold", lambda s, d: cells(red.histogram_threshold(quantity(s, d), "otsu", 64)[0]), CELLS + EDGES + OTSU + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CASE WHEN v <= (SELECT b FROM t) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM q")
for _name in red.RULES:
    if _name != "otsu":
        table(f"{_name}_threshold", lambda s, d, n=_name: red.histogram_threshold(quantity(s, d), n, 64)[1].select(F.round("threshold", 6).alias("threshold")), None)
table("otsu_multiple_thresholds", lambda s, d: cells(red.otsu_multiple_thresholds(quantity(s, d), 2, 64)[0]), None)
NEAR = {k: " AND ".join(f"abs(v - m{k}) {'<' if j < k else '<='} abs(v - m{j})" for j in (1, 2, 3) if j != k) for k in (1, 2, 3)}
table("scalar_image_kmeans", lambda s, d: cells(red.scalar_image_kmeans(quantity(s, d), [1000, 1300, 1600])[0]),
      CELLS + ", it AS (WITH RECURSIVE r(n, m1, m2, m3) AS (SELECT 0, 1000.0::DOUBLE, 1300.0::DOUBLE, 1600.0::DOUBLE UNION ALL SELECT n + 1, " + ", ".join(f"coalesce((SELECT avg(v) FROM q WHERE {near}), m{k})" for k, near in NEAR.items()) + " FROM r WHERE n < 100) SELECT * FROM r WHERE n = 100) "
      + f"SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CASE WHEN {NEAR[1]} THEN 0.0::DOUBLE WHEN {NEAR[2]} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS v FROM q, it")
table("hash_image", lambda s, d: red.hash_image(quantity(s, d)).select("digest"), CELLS + " SELECT md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x)) AS digest FROM q")

# Index remaps
LIMITS = ", l AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny FROM q)"


def moved(x: str, y: str, where: str = "true", value: str = "v", source: str = "q, l") -> str:
    return f"{CELLS}{LIMITS}\nSELECT CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y, round(CAST({value} AS DOUBLE), 6) AS v FROM {source} WHERE {where}"


def remap(name: str, fn: Callable[[Raster], Raster], sql: str) -> None:
    QUERIES[name] = (lambda s, d: cells(fn(quantity(s, d))), sql)


remap("region_of_interest", lambda r: geo.region_of_interest(r, (2, 3), (5, 4)), moved("x - 2", "y - 3", "x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 6"))
remap("crop", lambda r: geo.crop(r, (1, 2), (3, 1)), moved("x - 1", "y - 2", "x >= 1 AND x < nx - 3 AND y >= 2 AND y < ny - 1"))
table("extract", lambda s, d: geo.extract(quantity(s, d), (4, 0), (0, 8)).df.select(F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v")), CELLS + " SELECT CAST(y AS BIGINT) AS x, CAST(v AS DOUBLE) AS v FROM q WHERE x = 4 AND y < 8")
remap("flip", lambda r: geo.flip(r, ("x",)), moved("nx - 1 - x", "y"))
remap("permute_axes", lambda r: geo.permute_axes(r, (1, 0)), moved("y", "x"))
remap("slice", lambda r: geo.slice_axes(r, ((10, 0, -3), (1, 9, 2))), moved("(10 - x) // 3", "(y - 1) // 2", "x IN (10, 7, 4, 1) AND y IN (1, 3, 5, 7)"))
SHIFT = lambda n, f: f"CAST(greatest(0, floor(({n} - 1) / 2.0 - {f} * ({n} // {f} - 1) / 2.0 + 0.5)) AS BIGINT)"
remap("shrink", lambda r: geo.shrink(r, (5, 3)), moved(f"(x - {SHIFT('nx', 5)}) // 5", f"(y - {SHIFT('ny', 3)}) // 3", " AND ".join(f"{a} >= {SHIFT(n, f)} AND ({a} - {SHIFT(n, f)}) % {f} = 0 AND ({a} - {SHIFT(n, f)}) // {f} < {n} // {f}" for a, n, f in (("x", "nx", 5), ("y", "ny", 3)))))
remap("bin_shrink", lambda r: geo.bin_shrink(r, (5, 3)), CELLS + LIMITS + " SELECT CAST(x // 5 AS BIGINT) AS x, CAST(y // 3 AS BIGINT) AS y, floor(avg(v) + 0.5) AS v FROM q, l WHERE x < 5 * (nx // 5) AND y < 3 * (ny // 3) GROUP BY 1, 2")
remap("expand", lambda r: geo.expand(r, (2, 3)), moved("x * 2 + i", "y * 3 + j", source="q, l, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(3)) AS j)"))
remap("cyclic_shift", lambda r: geo.cyclic_shift(r, (5, -3)), moved("(x + 5) % nx", "(y - 3 + ny) % ny"))
remap("fft_shift", geo.fft_shift, moved("(x + nx // 2) % nx", "(y + ny // 2) % ny"))
GROWN = ", w AS (SELECT i, j FROM l, LATERAL (SELECT unnest(range(-2, nx + 3)) AS i), LATERAL (SELECT unnest(range(-1, ny + 4)) AS j))"


def padded(ix: str, jy: str, join: str = "JOIN", value: str = "q.v") -> str:
    return f"{CELLS}{LIMITS}{GROWN} SELECT CAST(i + 2 AS BIGINT) AS x, CAST(j + 1 AS BIGINT) AS y, CAST({value} AS DOUBLE) AS v FROM (SELECT w.*, l.* FROM w, l) w {join} q ON q.x = {ix} AND q.y = {jy}"


PAD = ((2, 1), (3, 4))
remap("constant_pad", lambda r: geo.constant_pad(r, *PAD, 7), padded("i", "j", "LEFT JOIN", "coalesce(q.v, 7)"))
remap("zero_flux_neumann_pad", lambda r: geo.zero_flux_pad(r, *PAD), padded("least(greatest(i, 0), nx - 1)", "least(greatest(j, 0), ny - 1)"))
remap("wrap_pad", lambda r: geo.wrap_pad(r, *PAD), padded("(i + nx) % nx", "(j + ny) % ny"))
remap("mirror_pad", lambda r: geo.mirror_pad(r, *PAD), padded("CASE WHEN i < 0 THEN -1 - i WHEN i >= nx THEN 2 * nx - 1 - i ELSE i END", "CASE WHEN j < 0 THEN -1 - j WHEN j >= ny THEN 2 * ny - 1 - j ELSE j END"))
table("checker_board", lambda s, d: cells(geo.checker_board(quantity(s, d), rows(s, d), (4, 1))), cells_sql("CASE WHEN (x // 3 + y // (SELECT max(y) + 1 FROM q)) % 2 = 1 THEN c ELSE v END"))
table("paste", lambda s, d: cells(geo.paste(quantity(s, d), geo.region_of_interest(rows(s, d), (0, 0), (3, 2)), (4, 5))), CELLS + " SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CAST(coalesce(p.c, q.v) AS DOUBLE) AS v FROM q LEFT JOIN (SELECT * FROM q WHERE x < 3 AND y < 2) p ON p.x + 4 = q.x AND p.y + 5 = q.y")
table("tile", lambda s, d: cells(geo.tile([quantity(s, d), rows(s, d)], "x")), CELLS + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(v AS DOUBLE) AS v FROM q UNION ALL SELECT x + 12, y, c FROM q")
table("join_series", lambda s, d: cells(geo.join_series([quantity(s, d), rows(s, d)])), CELLS + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, CAST(v AS DOUBLE) AS v FROM (SELECT x, y, 0 AS z, v FROM q UNION ALL SELECT x, y, 1, c FROM q)")
table("to_vector_image", lambda s, d: cells_1d(px.vector_magnitude(geo.to_vector(quantity(s, d)))), CELLS + " SELECT CAST(y AS BIGINT) AS x, round(sqrt(CAST(sum(v * v) AS DOUBLE)), 6) AS v FROM q GROUP BY y")


def cells_1d(r: Raster) -> DataFrame:
    value: Column = F.round(F.col("v").cast("double"), 6)
    return r.df.select(F.col("x").cast("long").alias("x"), value.alias("v"))
