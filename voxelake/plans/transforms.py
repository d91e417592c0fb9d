"""Queries of resampling, registration, region growing, noise, generators and image files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffusion as dif
from ..operators import geometry as geo
from ..operators import growing as gr
from ..operators import noise
from ..operators import registration as reg
from ..operators import resample as rs
from ..operators.lines import discrete_gaussian
from ..operators.pixelwise import component
from ..raster import Geometry
from ..sources import generators as gen
from ..sources import images
from .basic import CELLS, LIMITS, cells, cells_sql, moved, quantity, real, rows

QUERIES: dict = {}


def table(name: str, query, sql: str | None) -> None:
    QUERIES[name] = (query, sql)


# Resampling
table("resample_identity", lambda s, d: cells(rs.resample(real(s, d))), cells_sql("v"))
table("resample_translation_nearest", lambda s, d: cells(rs.resample(quantity(s, d), transform=rs.translation((2, -1)), interpolator="nearest", default=-1)),
      CELLS + " SELECT CAST(a.x AS BIGINT) AS x, CAST(a.y AS BIGINT) AS y, CAST(coalesce(b.v, -1) AS DOUBLE) AS v FROM q a LEFT JOIN q b ON b.x = a.x + 2 AND b.y = a.y - 1")
table("resample_translation_linear", lambda s, d: cells(rs.resample(real(s, d), transform=rs.translation((0.25, 0.5)), default=-1)),
      CELLS + LIMITS + """ SELECT CAST(a.x AS BIGINT) AS x, CAST(a.y AS BIGINT) AS y, round(CASE WHEN a.y + 0.5 < any_value(ny) - 0.5 THEN sum(b.v * w) ELSE -1 END, 6) AS v
FROM q a, l, (SELECT * FROM (VALUES (0, 0, 0.375::DOUBLE), (1, 0, 0.125::DOUBLE), (0, 1, 0.375::DOUBLE), (1, 1, 0.125::DOUBLE)) t(i, j, w)), q b
WHERE b.x = least(a.x + i, nx - 1) AND b.y = least(a.y + j, ny - 1) GROUP BY a.x, a.y""")  # fmt: skip
table("resample_scale", lambda s, d: cells(rs.resample(quantity(s, d), Geometry((6, 8)), rs.scale((2, 3)), "nearest")), moved("x // 2", "y // 3", "x % 2 = 0 AND y % 3 = 0 AND y < 24"))
table("resample_rotation", lambda s, d: cells(rs.resample(quantity(s, d), Geometry((12, 12)), rs.euler_2d(3.141592653589793 / 2, centre=(5.5, 5.5)), "nearest", -1)),
      CELLS + " SELECT CAST(y AS BIGINT) AS x, CAST(11 - x AS BIGINT) AS y, CAST(v AS DOUBLE) AS v FROM q WHERE y < 12")
table("warp", lambda s, d: cells(rs.warp(quantity(s, d), rs.displacement_field(quantity(s, d), rs.translation((1, 2))), "nearest", -1)),
      CELLS + " SELECT CAST(a.x AS BIGINT) AS x, CAST(a.y AS BIGINT) AS y, CAST(coalesce(b.v, -1) AS DOUBLE) AS v FROM q a LEFT JOIN q b ON b.x = a.x + 1 AND b.y = a.y + 2")
table("displacement_jacobian", lambda s, d: cells(rs.jacobian_determinant(rs.displacement_field(quantity(s, d), rs.scale((2, 3)))).map(lambda v: F.round(v, 4), "float64")),
      CELLS + LIMITS + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round((1 + CASE WHEN x IN (0, nx - 1) THEN 0.5 ELSE 1 END) * (1 + CASE WHEN y IN (0, ny - 1) THEN 1 ELSE 2 END), 4)::DOUBLE AS v FROM q, l")

for _name in rs.KERNELS:
    if _name != "linear":
        table(f"resample_{_name}", lambda s, d, n=_name: cells(rs.resample(real(s, d), transform=rs.translation((0.0, 0.0)) if n == "bspline" else rs.translation((0.25, 0.5)), interpolator=n).map(lambda v: F.round(v, 4), "float64")), cells_sql("v") if _name == "bspline" else None)

# Registration
table("metric_mean_squares", lambda s, d: reg.mean_squares(real(s, d), real(s, d), rs.translation((1, 0))).select(F.round("value", 4).alias("value"), "points"),
      CELLS + " SELECT round(avg(pow(a.v - b.v, 2)), 4) AS value, count(*) AS points FROM q a JOIN q b ON b.x = a.x + 1 AND b.y = a.y")
table("metric_correlation", lambda s, d: reg.correlation(real(s, d), real(s, d), rs.translation((0, 1))).select(F.round("value", 6).alias("value"), "points"),
      CELLS + " SELECT round(-pow(corr(a.v, b.v), 2), 6) AS value, count(*) AS points FROM q a JOIN q b ON b.x = a.x AND b.y = a.y + 1")
table("metric_mattes", lambda s, d: reg.mattes(real(s, d), rows(s, d, "float64"), rs.translation((0, 0)), 20).select(F.round("value", 6).alias("value"), "points"), None)
table("metric_neighborhood_correlation", lambda s, d: reg.neighborhood_correlation(real(s, d), rows(s, d, "float64"), rs.translation((0, 0)), (1, 1)).select(F.round("value", 6).alias("value"), "points"),
      CELLS + ", b AS (SELECT a.x, a.y, corr(n.v, n.c) AS r FROM q a JOIN q n ON abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1 GROUP BY a.x, a.y) SELECT round(-avg(r * r), 6) AS value, count(*) AS points FROM b")
table("metric_mutual_information",lambda s, d: reg.mutual_information(real(s, d), real(s, d), rs.translation((0, 0)), 16).select(F.round("value", 6).alias("value"), "points"), None)


def best_shift(spark, sf_dir):
    fixed = real(spark, sf_dir)
    moving = geo.cyclic_shift(fixed, (1, 2))
    best, value = reg.exhaustive(fixed, moving, rs.translation, [(0.0, 1.0), (1.0, 2.0)])
    return spark.createDataFrame([(*best, value)], "dx double, dy double, value double")


table("registration_exhaustive", best_shift, CELLS + LIMITS + """, m AS (SELECT (x + 1) % nx AS x, (y + 2) % ny AS y, v FROM q, l),
p AS (SELECT dx, dy, avg(pow(m.v - q.v, 2)) AS value FROM (SELECT unnest([0, 1]) AS dx) a, (SELECT unnest([1, 2]) AS dy) b, q JOIN m ON m.x = q.x + dx AND m.y = q.y + dy GROUP BY dx, dy)
SELECT CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, CAST(value AS DOUBLE) AS value FROM p ORDER BY value, dx, dy LIMIT 1""")


def smoothed(spark, sf_dir):
    return discrete_gaussian(real(spark, sf_dir), 4.0)


# Region growing
table("watershed", lambda s, d: cells(gr.watershed(quantity(s, d), 100)), None)
table("confidence_connected", lambda s, d: cells(gr.confidence_connected(quantity(s, d), [(4, 4)], 1.0, 2)), None)
table("neighborhood_connected", lambda s, d: cells(gr.neighborhood_connected(quantity(s, d), [(4, 4)], 800, 1700, (1, 0))), None)
table("fast_marching", lambda s, d: cells(gr.fast_marching(real(s, d).map(lambda v: F.when(v > 1100, 1.0).otherwise(0.5)), [(0, 0)]).map(lambda v: F.least(v, F.lit(1e9)), "float64")), None)

# Noise: the same for any partitioning
for _name, _fn in {"additive_gaussian_noise": noise.additive_gaussian_noise, "salt_and_pepper_noise": noise.salt_and_pepper_noise, "speckle_noise": noise.speckle_noise, "shot_noise": noise.shot_noise}.items():
    table(_name, lambda s, d, f=_fn: cells(f(real(s, d))), None)

# Iterated filters
def box_kernel(spark, sf_dir):
    """A 3-voxel mean along x, centred on voxel 0."""
    q = real(spark, sf_dir)
    return q.with_rows(q.df.withColumn("v", F.when((F.col("y") == 0) & F.col("x").isin(0, 1, 11), 1 / 3).otherwise(0.0)))


table("fft_convolution", lambda s, d: cells(dif.fft_convolution(real(s, d), box_kernel(s, d)).map(lambda v: F.round(v, 4), "float64")),
      CELLS + " SELECT CAST(a.x AS BIGINT) AS x, CAST(a.y AS BIGINT) AS y, round(sum(b.v) / 3.0::DOUBLE, 4) AS v FROM q a JOIN q b ON a.y = b.y AND (b.x - a.x + 13) % 12 IN (0, 1, 2) GROUP BY a.x, a.y")
table("histogram_matching", lambda s, d: cells(dif.histogram_matching(real(s, d), quantity(s, d).map(lambda v: v * 2))), cells_sql("2 * v"))
for _name, _fn in {
    "gradient_anisotropic_diffusion": lambda q: dif.gradient_anisotropic_diffusion(q, iterations=2), "curvature_anisotropic_diffusion": lambda q: dif.curvature_anisotropic_diffusion(q, iterations=2),
    "min_max_curvature_flow": lambda q: dif.min_max_curvature_flow(q, iterations=2), "canny_edge_detection": lambda q: dif.canny_edge_detection(q, 1.0, 40, 80),
    "adaptive_histogram_equalization": lambda q: dif.adaptive_histogram_equalization(q, (2, 2)), "objectness_measure": dif.objectness_measure,
    "zero_crossing_based_edge_detection": dif.zero_crossing_based_edge_detection,
}.items():
    table(_name, lambda s, d, f=_fn: cells(f(real(s, d))), None)
for _name, _fn in {"wiener_deconvolution": dif.wiener_deconvolution, "tikhonov_deconvolution": dif.tikhonov_deconvolution, "richardson_lucy_deconvolution": lambda a, b: dif.richardson_lucy(a, b, 2), "landweber_deconvolution": lambda a, b: dif.landweber(a, b, 0.5, 2)}.items():
    table(_name, lambda s, d, f=_fn: cells(f(real(s, d), box_kernel(s, d))), None)
table("demons_registration", lambda s, d: cells(component(dif.demons(smoothed(s, d), geo.cyclic_shift(smoothed(s, d), (0, 1)), iterations=3), 0)), None)
table("level_set", lambda s, d: cells(dif.level_set(smoothed(s, d).map(lambda v: (v - 1270) / 100), rows(s, d, "float64").map(lambda v: v / 50), iterations=3)), None)

# Generators
POINTS = "SELECT i * 0.5 - 1 AS px, j * 2 + 3 AS py, i, j FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(9)) AS j)"
GRID = Geometry((16, 9), (0.5, 2.0), (-1.0, 3.0))


def made(name: str, fn, value: str) -> None:
    table(name, lambda s, d: cells(fn(s)), f"SELECT CAST(i AS BIGINT) AS x, CAST(j AS BIGINT) AS y, round(CAST({value} AS DOUBLE), 6) + 0.0 AS v FROM ({POINTS})")


made("gaussian_source", lambda s: gen.gaussian_source(s, GRID, (2, 5), (3, 10)), "255 * exp(-pow(px - 3, 2) / 8 - pow(py - 10, 2) / 50)")
made("gabor_source", lambda s: gen.gabor_source(s, GRID, (2, 5), (3, 10), 0.3), "exp(-pow(px - 3, 2) / 8 - pow(py - 10, 2) / 50) * cos(2 * pi() * 0.3 * (px - 3))")
made("physical_point_source", lambda s: component(gen.physical_point_source(s, GRID), 1), "py")
made("grid_source", lambda s: gen.grid_source(s, GRID, (0.6, 0.7), (3, 4), (0.1, 0.2)), "255 * (1 - exp(-pow(px - 0.1 - round((px - 0.1) / 3) * 3, 2) / 0.72)) * (1 - exp(-pow(py - 0.2 - round((py - 0.2) / 4) * 4, 2) / 0.98))")

# Image files, encoded and decoded on the executors
for _format, _pixel in (("mha", "int32"), ("nrrd", "int32"), ("nii", "int32"), ("vtk", "int32"), ("gipl", "int32"), ("png", "uint16")):
    table(f"{_format}_round_trip", lambda s, d, f=_format, p=_pixel: cells(images.decode(images.encode(quantity(s, d, p), f), f)), cells_sql("v"))
