"""Queries of super-pixels, transforms with parameters, and registration with gradients."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import bias, contours
from ..operators import fields as fl
from ..operators import parametric as pm
from ..operators import resample as rs
from ..operators import superpixels as sp
from ..operators.lines import discrete_gaussian
from ..raster import PIXELS, Raster
from ..sources import parts
from ..staging import shared_dir, staged
from .basic import CELLS, LIMITS, cells, cells_sql, real, rows

QUERIES: dict = {}


def table(name: str, query, sql: str | None) -> None:
    QUERIES[name] = (query, sql)


# Super-pixels
FIRST = ", c0 AS (SELECT jx + 3 * jy AS label, CAST(v AS DOUBLE) AS value, jx * 4 + 1.5::DOUBLE AS cx, jy * 5 + (ny - 1) / 2.0::DOUBLE - 5 * (ny // 5 - 1) / 2.0::DOUBLE AS cy FROM l, (SELECT unnest(range(3)) AS jx), (SELECT unnest(range((SELECT count(*) // 12 // 5 FROM q))) AS jy), q WHERE x = jx * 4 + 2 AND y = jy * 5 + floor((ny - 1) / 2.0::DOUBLE - 5 * (ny // 5 - 1) / 2.0::DOUBLE + 0.5)), r0 AS (SELECT x, y, v, 0 AS label FROM q)"
ROUND = """, d{n} AS (SELECT x, y, label, CAST(value - v AS FLOAT) AS a, CAST((cx - x) * 10.0::DOUBLE AS FLOAT) AS b, CAST((cy - y) * 8.0::DOUBLE AS FLOAT) AS c FROM q JOIN c{p} ON abs(x - floor(cx + 0.5)) <= 4 AND abs(y - floor(cy + 0.5)) <= 5),
b{n} AS (SELECT x, y, label FROM d{n} QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY a * a + b * b + c * c, label) = 1),
r{n} AS (SELECT r.x, r.y, r.v, coalesce(b.label, r.label) AS label FROM r{p} r LEFT JOIN b{n} b USING (x, y)),
c{n} AS (SELECT label, avg(v) AS value, avg(x) AS cx, avg(y) AS cy FROM r{n} GROUP BY label)"""
table("slic_clusters", lambda s, d: cells(sp.slic(real(s, d), (4, 5), 40.0, 3, connected=False, perturb=False)[0]),
      CELLS + LIMITS + FIRST + "".join(ROUND.format(n=k, p=k - 1) for k in (1, 2, 3)) + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(label AS DOUBLE) AS v FROM r3")
table("slic", lambda s, d: cells(sp.slic(real(s, d), (4, 5), 40.0, 5)[0]), None)
table("slic_residual", lambda s, d: sp.slic(real(s, d), (4, 5), 40.0, 1, connected=False, perturb=False)[1].select(F.round("average_residual", 4).alias("residual")),
      CELLS + LIMITS + FIRST + ROUND.format(n=1, p=0) + " SELECT round(CASE WHEN count(c1.label) = count(*) THEN sqrt(sum(pow(c1.value - c0.value, 2) + pow(10 * (c1.cx - c0.cx), 2) + pow(8 * (c1.cy - c0.cy), 2))) / (count(*) * 3) ELSE 'nan' END, 4) AS residual FROM c0 LEFT JOIN c1 USING (label)")


# A B-spline lattice of 3 by 4 cells around the grid
def spline(r) -> pm.BSplineTransform:
    t = pm.BSplineTransform.around(r.geometry, (3, 4))
    n = t.controls.shape[1]
    return t.with_parameters(((np.arange(2 * n) % n) * 37 + np.arange(2 * n) // n * 11) % 17 / 20 - 0.4)


WEIGHT = "CASE WHEN abs({0}) < 1 THEN 2 / 3.0::DOUBLE - {0} * {0} + abs({0}) * {0} * {0} / 2 ELSE pow(2 - abs({0}), 3) / 6 END"
LATTICE = """, spot AS (SELECT x, y, (x + 0.625) / (12.25 / 3.0::DOUBLE) + 1 AS ix, (y + 0.625) / ((ny + 0.25) / 4.0::DOUBLE) + 1 AS iy FROM q, l),
taps AS (SELECT x, y, CAST(floor(ix) AS BIGINT) + i AS a, CAST(floor(iy) AS BIGINT) + j AS b, ix - floor(ix) - i AS p, iy - floor(iy) - j AS r FROM spot, (SELECT unnest(range(-1, 3)) AS i), (SELECT unnest(range(-1, 3)) AS j)),
moved AS (SELECT x, y, sum(w * (((a + 6 * b) * 37) % 17 / 20.0::DOUBLE - 0.4)) AS dx, sum(w * (((a + 6 * b) * 37 + 11) % 17 / 20.0::DOUBLE - 0.4)) AS dy FROM (SELECT *, """ + f"({WEIGHT.format('p')}) * ({WEIGHT.format('r')})" + """ AS w FROM taps) GROUP BY x, y)"""


def spline_displacement(spark, sf_dir):
    r = real(spark, sf_dir)
    return pm.displaced(r, spline(r).table(spark)).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), (F.round(F.col("d")[0], 6) + 0.0).alias("dx"), (F.round(F.col("d")[1], 6) + 0.0).alias("dy"))


table("bspline_displacement", spline_displacement, CELLS + LIMITS + LATTICE + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy FROM moved")


# Metrics with gradients: the quantities against the numbers of rows
def gradient(metric: str, transform_of, parameters: list[int]):
    def query(spark, sf_dir):
        fixed, moving = real(spark, sf_dir), rows(spark, sf_dir, "float64")
        got = al.evaluate(al.samples(fixed), al.moving_image(moving), transform_of(fixed), metric)[0]
        return spark.createDataFrame([(k, round(got.value, 5), round(float(got.gradient[k]), 5), got.points) for k in parameters], "k long, value double, slope double, points long")

    return query


TURN = pm.MatrixTransform("affine", 2, (1.01, 0.02, -0.015, 0.99, 0.3, -0.2), (5.5, 10.0))
LOOK = """, near AS (SELECT *, floor(px) AS fx, floor(py) AS fy, px - floor(px) AS s, py - floor(py) AS t FROM mapped, l WHERE px >= -0.5 AND px < nx - 0.5 AND py >= -0.5 AND py < ny - 0.5),
read AS (SELECT n.*, a.c AS c00, b.c AS c10, c.c AS c01, d.c AS c11 FROM near n, q a, q b, q c, q d
  WHERE a.x = greatest(fx, 0) AND a.y = greatest(fy, 0) AND b.x = least(fx + 1, nx - 1) AND b.y = a.y AND c.x = a.x AND c.y = least(fy + 1, ny - 1) AND d.x = b.x AND d.y = c.y),
seen AS (SELECT *, (1 - t) * ((1 - s) * c00 + s * c10) + t * ((1 - s) * c01 + s * c11) AS m, (1 - t) * (c10 - c00) + t * (c11 - c01) AS gx, (1 - s) * (c01 - c00) + s * (c11 - c10) AS gy FROM read)"""
MAPPED = ", mapped AS (SELECT x, y, v AS f, 1.01 * (x - 5.5) + 0.02 * (y - 10) + 5.5 + 0.3 AS px, -0.015 * (x - 5.5) + 0.99 * (y - 10) + 10 - 0.2 AS py FROM q)".replace("1.01", "1.01::DOUBLE")
PARTS = ", j AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest([gx * (x - 5.5), gx * (y - 10), gy * (x - 5.5), gy * (y - 10), gx, gy]) AS g FROM seen)"
table("metric_gradient_mean_squares", gradient("mean_squares", lambda r: TURN, list(range(6))),
      CELLS + LIMITS + MAPPED + LOOK + PARTS + " SELECT CAST(k AS BIGINT) AS k, round(avg(pow(m - f, 2)), 5) AS value, round(avg(2 * (m - f) * g), 5) AS slope, count(*) AS points FROM j GROUP BY k")
table("metric_gradient_correlation", gradient("correlation", lambda r: TURN, list(range(6))),
      CELLS + LIMITS + MAPPED + LOOK + PARTS + """ SELECT CAST(k AS BIGINT) AS k, round(-pow(fm, 2) / (ff * mm), 5) AS value, round(-2 * fm / (ff * mm) * (fg - fm / mm * mg), 5) AS slope, points
FROM (SELECT k, count(*) AS points, regr_sxy(f, m) AS fm, regr_syy(f, m) AS ff, regr_sxx(f, m) AS mm, regr_sxy(f, g) AS fg, regr_sxy(m, g) AS mg FROM j GROUP BY k)""")  # fmt: skip
table("metric_gradient_mattes", gradient("mattes", lambda r: TURN, list(range(6))), None)
table("metric_gradient_bspline", gradient("mean_squares", spline, [7, 14, 20, 42 + 21]),
      CELLS + LIMITS + LATTICE + ", mapped AS (SELECT q.x, q.y, v AS f, q.x + dx AS px, q.y + dy AS py FROM q JOIN moved USING (x, y))" + LOOK
      + f""", j AS (SELECT n.*, k, CASE WHEN k < 42 THEN gx ELSE gy END * ({WEIGHT.format('p')}) * ({WEIGHT.format('r')}) AS g FROM seen n JOIN taps USING (x, y) JOIN (SELECT unnest([7, 14, 20, 63]) AS k) ON k % 42 = a + 6 * b)
SELECT CAST(k AS BIGINT) AS k, round((SELECT avg(pow(m - f, 2)) FROM seen), 5) AS value, round(sum(2 * (m - f) * g) / (SELECT count(*) FROM seen), 5) AS slope, (SELECT count(*) FROM seen) AS points FROM j GROUP BY k""")  # fmt: skip


def found(want: pm.MatrixTransform, start: pm.MatrixTransform, **options):
    """The quantities, smoothed, against their resampling through a known transform: what the
    optimiser finds inside the border."""

    def query(spark, sf_dir):
        moving = discrete_gaussian(real(spark, sf_dir), 4.0)
        moving = moving.with_rows(staged(moving.df))
        inner = moving.map(lambda v: F.when((F.col("x") > 1) & (F.col("x") < 10) & (F.col("y") > 2) & (F.col("y") < moving.geometry.size[1] - 3), 1).otherwise(0), "uint8")
        scales = al.shift_scales(start, moving.geometry)
        got, _ = al.register(rs.resample(moving, transform=want.affine()), moving, start, scales=scales, fixed_mask=inner, **options)
        return spark.createDataFrame([(k, float(round(a, 2)), b) for k, (a, b) in enumerate(zip(got.parameters, want.parameters))], "k long, found double, planted double")

    return query


table("registration_lbfgs", found(pm.MatrixTransform("affine", 2, (1.02, 0.03, -0.02, 0.98, 0.4, 0.3), (5.5, 5.5)), pm.MatrixTransform("affine", 2, centre=(5.5, 5.5)), rounds=20), None)
table("registration_gradient_descent", found(pm.MatrixTransform("translation", 2, (0.5, -0.75)), pm.MatrixTransform("translation", 2), optimizer="regular_step", step=0.5, shortest=0.01, rounds=25), None)


# Bias correction; tests compare it with plain loops
table("n4_bias_field", lambda s, d: cells(bias.n4_bias_field(real(s, d), levels=(4, 3), controls=(4, 5))[1]), None)
table("n4_bias_field_correction", lambda s, d: cells(bias.n4_bias_field(real(s, d), levels=(4, 3), controls=(4, 5))[0]), None)


# A file in parts: the quantities as a TIFF file, of which a box is read
def tiff_region(spark, sf_dir):
    folder = f"{shared_dir(spark)}/voxelake/{uuid.uuid4().hex}"
    parts.write_tiff(real(spark, sf_dir).map(lambda v: v, "int32"), folder, "deflate", rows=8).collect()
    return cells(parts.read_tiff(spark, folder, [[2, 9], [5, 60]]))


table("tiff_region", tiff_region, cells_sql("v").replace("CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y", "CAST(x - 2 AS BIGINT) AS x, CAST(y - 5 AS BIGINT) AS y") + " WHERE x BETWEEN 2 AND 9 AND y BETWEEN 5 AND 60")


# Contour lines of the smoothed quantities
def lines(spark, sf_dir):
    found = contours.contour_lines(discrete_gaussian(real(spark, sf_dir), 2.0), 1270.0)
    return found.select("contour", "position", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


table("contour_extractor_2d", lines, None)


# Displacement fields from the quantities
def shifts(r, a: int, b: int) -> Raster:
    """Vectors from the remainders of the values."""
    v = F.col("v").cast("long")
    return Raster(r.df.select(*r.keys, F.array((v % a) / 10 - 0.3, (v % b) / 10 - 0.2).alias("v")), r.geometry, PIXELS["float64"])


def components(r: Raster):
    return r.df.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[(F.round(F.col("v")[k], 5) + 0.0).alias(n) for k, n in enumerate(("dx", "dy"))])


table("compose_displacement_fields", lambda s, d: components(fl.compose(shifts(real(s, d), 7, 5), shifts(real(s, d), 4, 6))), CELLS + LIMITS + """,
near AS (SELECT *, floor(px) AS fx, floor(py) AS fy FROM (SELECT x, y, dx, dy, x + dx AS px, y + dy AS py FROM (SELECT x, y, (v % 7) / 10.0::DOUBLE - 0.3 AS dx, (v % 5) / 10.0::DOUBLE - 0.2 AS dy FROM q)), l),
read AS (SELECT n.x, n.y, any_value(dx) AS dx, any_value(dy) AS dy, any_value(px >= -0.5 AND px < nx - 0.5 AND py >= -0.5 AND py < ny - 0.5) AS inside,
  sum(w * ((b.v % 4) / 10.0::DOUBLE - 0.3)) AS ux, sum(w * ((b.v % 6) / 10.0::DOUBLE - 0.2)) AS uy
  FROM (SELECT *, (CASE i WHEN 1 THEN px - fx ELSE 1 - px + fx END) * (CASE j WHEN 1 THEN py - fy ELSE 1 - py + fy END) AS w, least(greatest(fx + i, 0), nx - 1) AS bx, least(greatest(fy + j, 0), ny - 1) AS b_y FROM near, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) n JOIN q b ON b.x = bx AND b.y = b_y GROUP BY n.x, n.y)
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(dx + CASE WHEN inside THEN ux ELSE 0 END, 5) + 0.0 AS dx, round(dy + CASE WHEN inside THEN uy ELSE 0 END, 5) + 0.0 AS dy FROM read""")
table("invert_displacement_field", lambda s, d: components(fl.invert_displacement_field(shifts(real(s, d), 7, 5), 4)[0]), None)
