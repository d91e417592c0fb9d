"""Queries of neighbourhood, morphology, label and line operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as lab
from ..operators import lines as ln
from ..operators import morphology as mo
from ..operators import pixelwise as px
from ..operators import window as win
from ..raster import Raster
from ..sources import tables
from .basic import CELLS, LIMITS, cells, cells_sql, lines, quantity, real, rows

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = (query, sql)


def box(rx: int, ry: int, border: str = "clamp", value: str = "v") -> str:
    """CTE ``w``: every voxel with each value of its box (dx, dy, n)."""
    ix, jy = ("least(greatest(q.x + dx, 0), nx - 1)", "least(greatest(q.y + dy, 0), ny - 1)") if border == "clamp" else ("q.x + dx", "q.y + dy")
    return f"""{CELLS}{LIMITS},
p AS (SELECT x, y, {value} AS v FROM q),
o AS (SELECT dx, dy FROM (SELECT unnest(range(-{rx}, {rx + 1})) AS dx), (SELECT unnest(range(-{ry}, {ry + 1})) AS dy)),
w AS (SELECT q.x, q.y, q.v, dx, dy, n.v AS n FROM p q, o, l, p n WHERE n.x = {ix} AND n.y = {jy})"""


def over_box(value: str, rx: int, ry: int, border: str = "clamp", of: str = "v", where: str = "") -> str:
    return f"{box(rx, ry, border, of)} SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(CAST({value} AS DOUBLE), 6) + 0.0 AS v FROM w {where} GROUP BY x, y"


def near(name: str, fn: Callable[[Raster], Raster], sql: str | None, source: Callable = quantity) -> None:
    QUERIES[name] = (lambda s, d: cells(fn(source(s, d))), sql)


def high(s: SparkSession, d: str) -> Raster:
    """Cells of high quantity as a mask."""
    return px.binary_threshold(quantity(s, d), 1350, 1e9)


HIGH = "CASE WHEN v >= 1350 THEN 1 ELSE 0 END"

near("mean", lambda r: win.mean(r, (1, 2)), over_box("avg(n)", 1, 2), real)
near("mean_int", lambda r: win.mean(r, (2, 1)), over_box("trunc(sum(n) / 15.0::DOUBLE)", 2, 1))
near("box_mean", lambda r: win.box_mean(r, (1, 2)), over_box("avg(n)", 1, 2, "crop"), real)
near("box_sigma", lambda r: win.box_sigma(r, (1, 1)), over_box("stddev_samp(n)", 1, 1, "crop"))
near("noise", lambda r: win.noise(r, (1, 1)), over_box("stddev_samp(n)", 1, 1))
near("median", lambda r: win.median(r, (1, 1)), over_box("list_sort(list(n))[5]", 1, 1))
near("rank", lambda r: win.rank(r, (1, 1), 0.75), over_box("list_sort(list(n))[CAST(floor(0.75 * (count(*) - 1) + 0.5) AS BIGINT) + 1]", 1, 1, "crop"))
near("fast_approximate_rank", lambda r: win.fast_approximate_rank(r, (1, 1), 0.5), None)
AX = "sum(CASE WHEN dx = {0} AND dy = 0 THEN n END)"
AY = "sum(CASE WHEN dx = 0 AND dy = {0} THEN n END)"
GX, GY = (f"(({a.format(1)}) - ({a.format(-1)})) / 2.0::DOUBLE" for a in (AX, AY))
XX, YY = (f"(({a.format(1)}) + ({a.format(-1)}) - 2 * any_value(v))" for a in (AX, AY))
near("gradient_magnitude", lambda r: win.gradient_magnitude(r).map(lambda v: F.round(v.cast("double"), 2), "float64"), f"{box(1, 1)} SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(CAST(CAST(sqrt(pow({GX}, 2) + pow({GY}, 2)) AS FLOAT) AS DOUBLE), 2) AS v FROM w GROUP BY x, y")
near("gradient", lambda r: px.component(win.gradient(r), 1), over_box(GY, 1, 1))
near("derivative", lambda r: win.derivative(r, "x"), over_box(GX, 1, 1))
near("second_derivative", lambda r: win.derivative(r, "y", 2), over_box(YY, 1, 1))
near("laplacian", win.laplacian, over_box(f"{XX} + {YY}", 1, 1))
near("sobel_edge_detection", win.sobel_edge_detection, over_box("sqrt(pow(sum(n * dx * (2 - abs(dy))), 2) + pow(sum(n * dy * (2 - abs(dx))), 2))", 1, 1))
near("convolution", lambda r: win.convolve(r, [1, 2, 1, 2, 4, 2, 1, 2, 1], (1, 1)), over_box("sum(n * (2 - abs(dx)) * (2 - abs(dy)))", 1, 1))
near("zero_crossing", lambda r: win.zero_crossing(r.map(lambda v: v - 1275, "float64")), over_box(
    "max(CASE WHEN abs(dx) + abs(dy) = 1 AND ((v < 0 AND n > 0) OR (v > 0 AND n < 0) OR (v = 0 AND n <> 0) OR (v <> 0 AND n = 0)) AND (abs(v) < abs(n) OR (abs(v) = abs(n) AND dx + dy < 0)) THEN 1 ELSE 0 END)", 1, 1, "crop", "v - 1275"))
near("laplacian_sharpening", win.laplacian_sharpening, None)
near("bilateral", lambda r: win.bilateral(r, (1, 1), 1.5, 120), over_box("sum(n * exp(-(dx * dx + dy * dy) / 4.5) * exp(-pow(n - v, 2) / 28800.0)) / sum(exp(-(dx * dx + dy * dy) / 4.5) * exp(-pow(n - v, 2) / 28800.0))", 1, 1))
near("normalized_correlation", lambda r: win.normalized_correlation(r, [0, 1, 0, 1, 4, 1, 0, 1, 0], (1, 1)), over_box("CASE WHEN stddev_pop(n) > 0 THEN corr(n, CASE abs(dx) + abs(dy) WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 0 END) ELSE 0 END", 1, 1))
near("curvature_flow", lambda r: win.curvature_flow(r, 0.05, 2), None)

# Morphology
for _shape, _where in (("box", ""), ("cross", "WHERE dx = 0 OR dy = 0"), ("ball", "WHERE pow(dx / 2.5, 2) + pow(dy / 1.5, 2) <= 1")):
    near(f"grayscale_erode_{_shape}", lambda r, s=_shape: mo.grayscale_erode(r, (2, 1), s), over_box("min(n)", 2, 1, "crop", where=_where))
    near(f"grayscale_dilate_{_shape}", lambda r, s=_shape: mo.grayscale_dilate(r, (2, 1), s), over_box("max(n)", 2, 1, "crop", where=_where))
near("morphological_gradient", lambda r: mo.morphological_gradient(r, (1, 1)), over_box("max(n) - min(n)", 1, 1, "crop"))


def twice(first: str, second: str, value: str) -> str:
    """An inner and an outer extreme over 3 x 3 boxes."""
    return f"""{box(1, 1, 'crop')}, a AS (SELECT x, y, any_value(v) AS v, {first}(n) AS n FROM w GROUP BY x, y),
b AS (SELECT a.x, a.y, any_value(a.v) AS v, {second}(m.n) AS n FROM a, a m WHERE abs(a.x - m.x) <= 1 AND abs(a.y - m.y) <= 1 GROUP BY a.x, a.y)
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST({value} AS DOUBLE) AS v FROM b"""


near("grayscale_morphological_opening", lambda r: mo.grayscale_opening(r, (1, 1)), twice("min", "max", "n"))
near("grayscale_morphological_closing", lambda r: mo.grayscale_closing(r, (1, 1)), twice("max", "min", "n"))
near("white_top_hat", lambda r: mo.white_top_hat(r, (1, 1)), twice("min", "max", "v - n"))
near("black_top_hat", lambda r: mo.black_top_hat(r, (1, 1)), twice("max", "min", "n - v"))
near("binary_dilate", lambda r: mo.binary_dilate(r, (1, 1), "cross"), over_box("max(n)", 1, 1, "crop", HIGH, "WHERE dx = 0 OR dy = 0"), high)
near("binary_erode", lambda r: mo.binary_erode(r, (1, 1), "cross"), over_box("min(n)", 1, 1, "crop", HIGH, "WHERE dx = 0 OR dy = 0"), high)
near("binary_morphological_opening", lambda r: mo.binary_opening(r, (1, 0)), None, high)
near("binary_morphological_closing", lambda r: mo.binary_closing(r, (1, 0)), None, high)
near("voting_binary", lambda r: mo.voting_binary(r, (1, 1), 4, 2), over_box("CASE WHEN any_value(v) = 0 AND sum(n) >= 4 THEN 1 WHEN any_value(v) = 1 AND sum(n) - 1 < 2 THEN 0 ELSE any_value(v) END", 1, 1, "clamp", HIGH), high)
near("voting_binary_hole_filling", lambda r: mo.voting_hole_filling(r, (1, 1)), over_box("CASE WHEN any_value(v) = 0 AND sum(n) >= 5 THEN 1 ELSE any_value(v) END", 1, 1, "clamp", HIGH), high)
near("voting_binary_iterative_hole_filling", lambda r: mo.voting_iterative_hole_filling(r, (1, 1), 1, 3), None, high)
near("binary_median", lambda r: mo.binary_median(r, (1, 1)), over_box("CASE WHEN sum(n) > 4 THEN 1 ELSE 0 END", 1, 1, "clamp", HIGH), high)
near("binary_contour", mo.binary_contour, over_box("CASE WHEN any_value(v) = 1 AND min(n) = 0 THEN 1 ELSE 0 END", 1, 1, "crop", HIGH, "WHERE dx = 0 OR dy = 0"), high)
near("label_contour", lambda r: mo.label_contour(r.map(lambda v: F.floor(v / 200)), True), over_box("CASE WHEN any_value(v) <> 0 AND (min(n) <> any_value(v) OR max(n) <> any_value(v)) THEN any_value(v) ELSE 0 END", 1, 1, "crop", "v // 200"))

# Components: the voxels of m that reach each other, by a recursive query
REACH = """, m AS (SELECT x, y, x + 12 * y AS p FROM q WHERE v >= 1350),
r AS (WITH RECURSIVE reach(x, y, p) AS (SELECT x, y, p FROM m UNION SELECT n.x, n.y, r.p FROM reach r JOIN m n ON {near})
  SELECT x, y, min(p) AS root FROM reach GROUP BY x, y),
c AS (SELECT x, y, dense_rank() OVER (ORDER BY root) AS label FROM r)"""
FACE, FULL = "abs(n.x - r.x) + abs(n.y - r.y) = 1", "greatest(abs(n.x - r.x), abs(n.y - r.y)) = 1"
SELECT_LABEL = " SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CAST(coalesce(label, 0) AS DOUBLE) AS v FROM q LEFT JOIN c USING (x, y)"
near("connected_component", lab.connected_component, CELLS + REACH.format(near=FACE) + SELECT_LABEL, high)
near("connected_component_full", lambda r: lab.connected_component(r, True), CELLS + REACH.format(near=FULL) + SELECT_LABEL, high)
near("relabel_component", lambda r: lab.relabel_component(lab.connected_component(r), 3), CELLS + REACH.format(near=FACE) + ", z AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS new FROM c GROUP BY label HAVING count(*) >= 3)"
     " SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CAST(coalesce(new, 0) AS DOUBLE) AS v FROM q LEFT JOIN c USING (x, y) LEFT JOIN z USING (label)", high)  # fmt: skip
table("double_threshold", lambda s, d: cells(lab.threshold_components(quantity(s, d), 1350, 1e9, 1500, 1e9)), CELLS + REACH.format(near=FACE) + ", k AS (SELECT DISTINCT label FROM c JOIN q USING (x, y) WHERE v >= 1500)"
      " SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CASE WHEN k.label IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM q LEFT JOIN c USING (x, y) LEFT JOIN k USING (label)")  # fmt: skip
table("connected_threshold", lambda s, d: cells(lab.connected_threshold(quantity(s, d), [(3, 5), (8, 40)], 1275, 1e9)), CELLS + """, m AS (SELECT x, y FROM q WHERE v >= 1275),
r AS (WITH RECURSIVE reach(x, y) AS (SELECT x, y FROM m WHERE (x, y) IN ((3, 5), (8, 40)) UNION SELECT n.x, n.y FROM reach r JOIN m n ON abs(n.x - r.x) + abs(n.y - r.y) = 1) SELECT * FROM reach)
SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CASE WHEN r.x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM q LEFT JOIN r USING (x, y)""")
near("scalar_connected_component", lambda r: lab.scalar_connected_component(r, 20), CELLS + """, r AS (WITH RECURSIVE reach(x, y, v, p) AS (SELECT x, y, v, x + 12 * y FROM q UNION SELECT n.x, n.y, n.v, r.p FROM reach r JOIN q n ON abs(n.x - r.x) + abs(n.y - r.y) = 1 AND abs(n.v - r.v) <= 20)
  SELECT x, y, min(p) AS root FROM reach GROUP BY x, y)
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(dense_rank() OVER (ORDER BY root) AS DOUBLE) AS v FROM r""")
HOLES = """, b AS (SELECT x, y FROM q WHERE v < 1350),
r AS (WITH RECURSIVE reach(x, y) AS (SELECT x, y FROM b, l WHERE x IN (0, nx - 1) OR y IN (0, ny - 1) UNION SELECT n.x, n.y FROM reach r JOIN b n ON abs(n.x - r.x) + abs(n.y - r.y) = 1) SELECT * FROM reach)
SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CASE WHEN r.x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM q LEFT JOIN r USING (x, y)"""
near("binary_fillhole", mo.binary_fillhole, CELLS + LIMITS + HOLES, high)
near("binary_grind_peak", mo.binary_grind_peak, CELLS + LIMITS + HOLES.replace("v < 1350", "v >= 1350").replace("THEN 1.0::DOUBLE ELSE 0.0::DOUBLE", "THEN 0.0::DOUBLE ELSE 1.0::DOUBLE"), high)
table("binary_reconstruction_by_dilation", lambda s, d: cells(mo.binary_reconstruction(px.binary_threshold(quantity(s, d), 1500, 1e9), high(s, d))), QUERIES["double_threshold"][1])
for _name, _fn in {
    "reconstruction_by_dilation": lambda r: mo.reconstruction(r.map(lambda v: v - 100), r), "reconstruction_by_erosion": lambda r: mo.reconstruction(r.map(lambda v: v + 100), r, "erosion"),
    "grayscale_fillhole": mo.grayscale_fillhole, "grayscale_grindpeak": mo.grayscale_grindpeak, "h_maxima": lambda r: mo.h_maxima(r, 100), "h_minima": lambda r: mo.h_minima(r, 100),
    "h_convex": lambda r: mo.h_convex(r, 100), "h_concave": lambda r: mo.h_concave(r, 100), "opening_by_reconstruction": lambda r: mo.opening_by_reconstruction(r, (1, 1)), "closing_by_reconstruction": lambda r: mo.closing_by_reconstruction(r, (1, 1)),
}.items():
    near(_name, _fn, None)

# Labels
SHADES = "v % 4"


def shades(s: SparkSession, d: str) -> Raster:
    return quantity(s, d).map(lambda v: v % 4)


table("label_statistics", lambda s, d: lab.label_statistics(quantity(s, d), shades(s, d)).select(F.col("label").cast("long").alias("label"), "count", "minimum", "maximum", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "sum", *[F.col(c).cast("long").alias(c) for c in ("min_x", "max_x", "min_y", "max_y")]),
      CELLS + " SELECT v % 4 AS label, count(*) AS count, CAST(min(v) AS DOUBLE) AS minimum, CAST(max(v) AS DOUBLE) AS maximum, round(avg(v), 6) AS mean, round(var_samp(v), 4) AS variance, CAST(sum(v) AS DOUBLE) AS sum, CAST(min(x) AS BIGINT) AS min_x, CAST(max(x) AS BIGINT) AS max_x, CAST(min(y) AS BIGINT) AS min_y, CAST(max(y) AS BIGINT) AS max_y FROM q GROUP BY 1")
table("label_shape_statistics", lambda s, d: lab.label_shape_statistics(shades(s, d)).select(F.col("label").cast("long").alias("label"), "voxels", "border_voxels", *[F.round(c, 5).alias(c) for c in ("centroid_x", "centroid_y", "moment_xx", "moment_xy", "moment_yy", "principal_low", "principal_high")]),
      CELLS + LIMITS + """, a AS (SELECT v % 4 AS label, count(*) AS voxels, count(*) FILTER (x IN (0, nx - 1) OR y IN (0, ny - 1)) AS border_voxels, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM q, l WHERE v % 4 <> 0 GROUP BY 1)
SELECT label, voxels, border_voxels, round(cx, 5) AS centroid_x, round(cy, 5) AS centroid_y, round(xx, 5) AS moment_xx, round(xy, 5) AS moment_xy, round(yy, 5) AS moment_yy,
  round((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy), 5) AS principal_low, round((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy), 5) AS principal_high FROM a""")  # fmt: skip
table("label_intensity_statistics", lambda s, d: lab.label_intensity_statistics(quantity(s, d), shades(s, d)).select(F.col("label").cast("long").alias("label"), "count", "sum", F.round("weighted_x", 6).alias("weighted_x"), F.round("weighted_y", 6).alias("weighted_y")),
      CELLS + " SELECT v % 4 AS label, count(*) AS count, CAST(sum(v) AS DOUBLE) AS sum, round(sum(v * x) / CAST(sum(v) AS DOUBLE), 6) AS weighted_x, round(sum(v * y) / CAST(sum(v) AS DOUBLE), 6) AS weighted_y FROM q WHERE v % 4 <> 0 GROUP BY 1")
table("label_overlap_measures", lambda s, d: lab.label_overlap(shades(s, d), rows(s, d).map(lambda v: v % 4)).select(F.col("label").cast("long").alias("label"), *[F.round(c, 6).alias(c) for c in ("jaccard", "dice", "volume_similarity", "false_negative", "false_positive")]),
      CELLS + """, a AS (SELECT k AS label, count(*) FILTER (v % 4 = k) AS s, count(*) FILTER (c % 4 = k) AS t, count(*) FILTER (v % 4 = k AND c % 4 = k) AS b FROM q, (SELECT unnest([1, 2, 3]) AS k) GROUP BY k)
SELECT CAST(label AS BIGINT) AS label, round(b / (s + t - b), 6) AS jaccard, round(2 * b / (s + t), 6) AS dice, round(2 * (s - t) / (s + t), 6) AS volume_similarity, round((t - b) / t, 6) AS false_negative, round((s - b) / s, 6) AS false_positive FROM a""")  # fmt: skip
table("similarity_index", lambda s, d: lab.similarity_index(high(s, d), px.binary_threshold(rows(s, d), 52, 1e9)).select(F.round("similarity", 6).alias("similarity")), CELLS + " SELECT round(2 * count(*) FILTER (v >= 1350 AND c >= 52) / (count(*) FILTER (v >= 1350) + count(*) FILTER (c >= 52)), 6) AS similarity FROM q")
table("label_voting", lambda s, d: cells(lab.label_voting([r.map(lambda v: v % 3) for r in (quantity(s, d), rows(s, d), lines(s, d))], 9)), cells_sql("CASE WHEN v % 3 = c % 3 OR v % 3 = d % 3 THEN v % 3 WHEN c % 3 = d % 3 THEN c % 3 ELSE 9 END"))
table("staple", lambda s, d: cells(lab.staple([high(s, d), px.binary_threshold(rows(s, d), 52, 1e9), px.binary_threshold(lines(s, d), 205, 1e9)])[0]), None)
RUNS = ", g2 AS (SELECT *, x - row_number() OVER (PARTITION BY y, v % 4 ORDER BY x) AS isl FROM q WHERE v % 4 <> 0), runs AS (SELECT v % 4 AS label, y, min(x) AS x, count(*) AS len FROM g2 GROUP BY v % 4, y, isl)"


def runs_out(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) for c in ("label", "x", "y", "len")])


table("label_image_to_label_map", lambda s, d: runs_out(lab.to_label_map(shades(s, d))), CELLS + RUNS + " SELECT CAST(label AS BIGINT) AS label, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(len AS BIGINT) AS len FROM runs")
table("label_map_to_label_image", lambda s, d: cells(lab.from_label_map(lab.to_label_map(shades(s, d)), quantity(s, d))), cells_sql(SHADES))
AGAIN = ", g3 AS (SELECT *, x - row_number() OVER (PARTITION BY y, k ORDER BY x) AS isl FROM (SELECT x, y, {k} AS k FROM q WHERE v % 4 <> 0)) SELECT CAST(k AS BIGINT) AS label, CAST(min(x) AS BIGINT) AS x, CAST(y AS BIGINT) AS y, count(*) AS len FROM g3 GROUP BY k, y, isl"
table("change_label_label_map", lambda s, d: runs_out(lab.change_label_map(lab.to_label_map(shades(s, d)), {2: 1})), CELLS + AGAIN.format(k="CASE v % 4 WHEN 2 THEN 1 ELSE v % 4 END"))
table("aggregate_label_map", lambda s, d: runs_out(lab.aggregate_label_map(lab.to_label_map(shades(s, d)))), CELLS + AGAIN.format(k="1"))
table("relabel_label_map", lambda s, d: runs_out(lab.relabel_label_map(lab.to_label_map(shades(s, d).map(lambda v: v * 5)))), CELLS + AGAIN.format(k="v % 4"))
table("label_map_mask", lambda s, d: cells(lab.label_map_mask(lab.to_label_map(shades(s, d)), quantity(s, d), 2)), cells_sql("CASE WHEN v % 4 = 2 THEN v ELSE 0 END"))

# Line kernels
near("binomial_blur", ln.binomial_blur, over_box("sum(n * (2 - abs(dx)) * (2 - abs(dy))) / 16.0::DOUBLE", 1, 1))
near("smooth_gaussian", lambda r: ln.smooth_gaussian(r, 0.5), over_box("sum(n * exp(-(dx * dx + dy * dy) / 0.5::DOUBLE)) / sum(exp(-(dx * dx + dy * dy) / 0.5::DOUBLE))", 2, 2))
near("distance_map", ln.squared_distance_map, CELLS + " SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CAST(min(pow(q.x - n.x, 2) + pow(q.y - n.y, 2)) AS DOUBLE) AS v FROM q, q n WHERE n.v >= 1350 GROUP BY q.x, q.y", high)
HAUSDORFF = CELLS + ", a AS (SELECT x, y FROM q WHERE v >= 1350), b AS (SELECT x, y FROM q WHERE c >= 52), {u} SELECT round(max(d), 6) AS maximum, round(avg(d), 6) AS mean FROM u"
table("directed_hausdorff_distance", lambda s, d: ln.directed_hausdorff(high(s, d), px.binary_threshold(rows(s, d), 52, 1e9)).select(F.round("maximum", 6).alias("maximum"), F.round("mean", 6).alias("mean")),
      HAUSDORFF.format(u="u AS (SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM a, b GROUP BY a.x, a.y)"))
table("hausdorff_distance", lambda s, d: ln.hausdorff_distance(high(s, d), px.binary_threshold(rows(s, d), 52, 1e9)).select(F.round("distance", 6).alias("distance")),
      CELLS + ", a AS (SELECT x, y FROM q WHERE v >= 1350), b AS (SELECT x, y FROM q WHERE c >= 52) SELECT round(max(d), 6) AS distance FROM (SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM a, b GROUP BY a.x, a.y UNION ALL SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM a, b GROUP BY b.x, b.y)")
table("fft_round_trip", lambda s, d: cells(ln.inverse_fft(ln.forward_fft(quantity(s, d))).map(lambda v: F.round(v, 4), "float64")), cells_sql("v"))
for _name, _fn in {
    "discrete_gaussian": lambda r: ln.discrete_gaussian(r, 1.0), "recursive_gaussian": lambda r: ln.recursive_gaussian(r, 1.0, "x"), "smoothing_recursive_gaussian": lambda r: ln.smoothing_recursive_gaussian(r, 1.0),
    "gradient_magnitude_recursive_gaussian": lambda r: ln.gradient_magnitude_recursive_gaussian(r, 1.0), "laplacian_recursive_gaussian": lambda r: ln.laplacian_recursive_gaussian(r, 1.0), "unsharp_mask": lambda r: ln.unsharp_mask(r, 1.0),
    "fft_low_pass": lambda r: ln.fft_filter(r, lambda fx, fy: F.exp(-(fx * fx + fy * fy) * 20)),
}.items():
    near(_name, _fn, None)
near("signed_maurer_distance_map", ln.signed_maurer_distance_map, None, high)
table("events_by_hour_components", lambda s, d: cells(lab.connected_component(tables.by_hour(s, d).map(lambda v: F.when(v >= 5, v).otherwise(0)))), """
WITH s AS (SELECT hour(ts) AS x, user_id AS y FROM events GROUP BY 1, 2 HAVING count(*) >= 5),
r AS (WITH RECURSIVE reach(x, y, p) AS (SELECT x, y, x + 24 * y FROM s UNION SELECT n.x, n.y, r.p FROM reach r JOIN s n ON abs(n.x - r.x) + abs(n.y - r.y) = 1) SELECT x, y, min(p) AS root FROM reach GROUP BY x, y)
SELECT CAST(gx AS BIGINT) AS x, CAST(gy AS BIGINT) AS y, CAST(coalesce(label, 0) AS DOUBLE) AS v FROM (SELECT unnest(range(24)) AS gx), (SELECT unnest(range((SELECT max(user_id) + 1 FROM events))) AS gy)
LEFT JOIN (SELECT x, y, dense_rank() OVER (ORDER BY root) AS label FROM r) c ON c.x = gx AND c.y = gy""")  # fmt: skip

# More morphology and colours
near("regional_maxima", mo.regional_extrema, CELLS + """, r AS (WITH RECURSIVE reach(x, y, v, p) AS (SELECT x, y, v, x + 12 * y FROM q UNION SELECT n.x, n.y, n.v, r.p FROM reach r JOIN q n ON abs(n.x - r.x) + abs(n.y - r.y) = 1 AND n.v = r.v)
  SELECT x, y, any_value(v) AS v, min(p) AS root FROM reach GROUP BY x, y),
h AS (SELECT DISTINCT r.root FROM r JOIN q n ON abs(n.x - r.x) + abs(n.y - r.y) = 1 AND n.v > r.v)
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CASE WHEN h.root IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM r LEFT JOIN h USING (root)""")
QUERIES["regional_minima"] = (lambda s, d: cells(mo.regional_extrema(quantity(s, d), maxima=False)), QUERIES["regional_maxima"][1].replace("n.v > r.v", "n.v < r.v"))
table("grayscale_geodesic_dilate", lambda s, d: cells(mo.geodesic_dilate(quantity(s, d).map(lambda v: v - 50), quantity(s, d))), over_box("least(any_value(v), max(n) - 50)", 1, 1, "crop", where="WHERE dx = 0 OR dy = 0"))
table("grayscale_geodesic_erode", lambda s, d: cells(mo.geodesic_erode(quantity(s, d).map(lambda v: v + 50), quantity(s, d))), over_box("greatest(any_value(v), min(n) + 50)", 1, 1, "crop", where="WHERE dx = 0 OR dy = 0"))
near("grayscale_connected_opening", lambda r: mo.connected_opening(r, (4, 5)), None)
near("grayscale_connected_closing", lambda r: mo.connected_opening(r, (4, 5), closing=True), None)
near("simple_contour_extractor", lambda r: mo.simple_contour_extractor(r, (1, 1)), over_box("CASE WHEN any_value(v) = 1 AND min(n) = 0 THEN 1 ELSE 0 END", 1, 1, "clamp", HIGH), high)
near("binary_thinning", mo.binary_thinning, None, high)
near("scalar_to_rgb_colormap", lambda r: px.component(px.scalar_to_rgb(r, "hot"), 0), cells_sql("floor(least(greatest((v - lo) / CAST(hi - lo AS DOUBLE) * 63 / 26 - 1 / 13.0::DOUBLE, 0), 1) * 255 + 0.5)", "(SELECT q.*, (SELECT min(v) FROM q) AS lo, (SELECT max(v) FROM q) AS hi FROM q)"))
PALETTE = [(255, 0, 0), (0, 205, 0), (0, 0, 255)]
table("label_overlay", lambda s, d: cells(px.component(px.label_overlay(quantity(s, d).map(lambda v: v % 256), shades(s, d), PALETTE), 1)), cells_sql("CASE v % 4 WHEN 0 THEN v % 256 WHEN 1 THEN floor(205 * 0.5 + (v % 256) * 0.5) ELSE floor((v % 256) * 0.5) END"))
table("label_map_to_rgb", lambda s, d: cells(px.component(lab.label_map_to_rgb(lab.to_label_map(shades(s, d)), quantity(s, d), PALETTE), 1)), cells_sql("CASE v % 4 WHEN 1 THEN 205 ELSE 0 END"))
table("label_map_overlay", lambda s, d: cells(px.component(lab.label_map_overlay(lab.to_label_map(shades(s, d)), quantity(s, d).map(lambda v: v % 256), PALETTE), 1)), QUERIES["label_overlay"][1])
table("label_map_contour_overlay", lambda s, d: cells(px.component(lab.label_map_contour_overlay(lab.to_label_map(shades(s, d)), quantity(s, d).map(lambda v: v % 256), PALETTE), 1)), over_box(
    "CASE WHEN any_value(v) % 4 <> 0 AND bool_or(n % 4 <> v % 4) THEN floor(CASE any_value(v) % 4 WHEN 1 THEN 102.5 ELSE 0 END + (any_value(v) % 256) * 0.5) ELSE any_value(v) % 256 END", 1, 1, "crop", where="WHERE dx = 0 OR dy = 0"))
near("area_opening", lambda r: mo.area_opening(r, 3), None)
near("area_closing", lambda r: mo.area_closing(r, 3), None)
