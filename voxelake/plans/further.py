"""Queries of label tools, object morphology, reconstructions, distances, spectra and orientation, and
SQL for rules that need a recursive or chained query."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffusion as dif
from ..operators import geometry as geo
from ..operators import growing as gr
from ..operators import labels as lab
from ..operators import lines as ln
from ..operators import morphology as mo
from ..operators import reduce as red
from ..operators import window as win
from ..raster import PIXELS, Geometry, Raster
from .basic import CELLS, EDGES, LIMITS, cells, cells_sql, quantity, real
from .spatial import FACE, HIGH, REACH, RUNS, SHADES, box, high, over_box, runs_out, shades

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
CELL = "CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, "
SIDES = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy)"


def table(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = (query, sql)


def near(name: str, fn: Callable[[Raster], Raster], sql: str | None, source: Callable = quantity) -> None:
    table(name, lambda s, d: cells(fn(source(s, d))), sql)


def out(value: str, source: str = "r") -> str:
    return f" SELECT {CELL}round(CAST({value} AS DOUBLE), 6) + 0.0 AS v FROM {source}"


# Reconstruction: the marker's values travel under the mask, cell by cell, as long as they raise a cell.


def rebuilt(mask: str, marker: str, source: str = "q", before: str = CELLS + LIMITS) -> str:
    """CTE ``r``: the marker spread under the mask, both as expressions of ``source``."""
    return f"""{before}, z AS (SELECT x, y, {mask} AS m, least({marker}, {mask}) AS k FROM {source}),
r AS (WITH RECURSIVE reach(x, y, v) AS (SELECT x, y, k FROM z UNION
    SELECT n.x, n.y, least(r.v, n.m) FROM reach r, {SIDES} JOIN z n ON n.x = r.x + dx AND n.y = r.y + dy WHERE least(r.v, n.m) > n.k)
  SELECT x, y, max(v) AS v FROM reach GROUP BY x, y)"""


RIM = "x IN (0, (SELECT nx FROM l) - 1) OR y IN (0, (SELECT ny FROM l) - 1)"
JOINED = "r JOIN q USING (x, y)"
LOW, TOP = "(SELECT min(v) FROM q)", "(SELECT max(v) FROM q)"
near("reconstruction_by_dilation", lambda r: mo.reconstruction(r.map(lambda v: v - 100), r), rebuilt("v", "v - 100") + out("v"))
near("reconstruction_by_erosion", lambda r: mo.reconstruction(r.map(lambda v: v + 100), r, "erosion"), rebuilt("-v", "-v - 100") + out("-v"))
near("h_maxima", lambda r: mo.h_maxima(r, 100), rebuilt("v", "v - 100") + out("v"))
near("h_minima", lambda r: mo.h_minima(r, 100), rebuilt("-v", "-v - 100") + out("-v"))
near("h_convex", lambda r: mo.h_convex(r, 100), rebuilt("v", "v - 100") + out("q.v - r.v", JOINED))
near("h_concave", lambda r: mo.h_concave(r, 100), rebuilt("-v", "-v - 100") + out("-r.v - q.v", JOINED))
near("grayscale_fillhole", mo.grayscale_fillhole, rebuilt("-v", f"CASE WHEN {RIM} THEN -v ELSE -{TOP} END") + out("-v"))
near("grayscale_grindpeak", mo.grayscale_grindpeak, rebuilt("v", f"CASE WHEN {RIM} THEN v ELSE {LOW} END") + out("v"))
near("grayscale_connected_opening", lambda r: mo.connected_opening(r, (4, 5)), rebuilt("v", f"CASE WHEN x = 4 AND y = 5 THEN v ELSE {LOW} END") + out("v"))
near("grayscale_connected_closing", lambda r: mo.connected_opening(r, (4, 5), closing=True), rebuilt("-v", f"CASE WHEN x = 4 AND y = 5 THEN -v ELSE -{TOP} END") + out("-v"))
BOXED = box(1, 1, "crop") + ", e AS (SELECT x, y, any_value(v) AS v, min(n) AS low, max(n) AS high FROM w GROUP BY x, y)"
near("opening_by_reconstruction", lambda r: mo.opening_by_reconstruction(r, (1, 1)), rebuilt("v", "low", "e", BOXED) + out("v"))
near("closing_by_reconstruction", lambda r: mo.closing_by_reconstruction(r, (1, 1)), rebuilt("-v", "-high", "e", BOXED) + out("-v"))
BOXED_HIGH = box(1, 0, "crop", HIGH) + ", e AS (SELECT x, y, any_value(v) AS v, min(n) AS low, max(n) AS high FROM w GROUP BY x, y)"
near("binary_opening_by_reconstruction", lambda r: mo.binary_opening_by_reconstruction(r, (1, 0)), rebuilt("v", "low", "e", BOXED_HIGH) + out("v"), high)
near("binary_closing_by_reconstruction", lambda r: mo.binary_closing_by_reconstruction(r, (1, 0)), rebuilt("1 - v", "1 - high", "e", BOXED_HIGH) + out("1 - v"), high)
table("binary_reconstruction_by_erosion", lambda s, d: cells(mo.binary_reconstruction_by_erosion(quantity(s, d).map(lambda v: F.when(v >= 1200, 1).otherwise(0)), high(s, d))),
      rebuilt(f"1 - ({HIGH})", "CASE WHEN v >= 1200 THEN 0 ELSE 1 END") + out("1 - v"))
ZONES = CELLS + f""", r AS (WITH RECURSIVE reach(x, y, v, p) AS (SELECT x, y, v, x + 12 * y FROM q UNION
    SELECT n.x, n.y, n.v, r.p FROM reach r, {SIDES} JOIN q n ON n.x = r.x + dx AND n.y = r.y + dy WHERE n.v = r.v)
  SELECT x, y, any_value(v) AS v, min(p) AS root FROM reach GROUP BY x, y),
h AS (SELECT DISTINCT r.root FROM r, {SIDES} JOIN q n ON n.x = r.x + dx AND n.y = r.y + dy WHERE n.v {{than}} r.v)"""
near("valued_regional_maxima", mo.valued_regional_extrema, ZONES.format(than=">") + out("CASE WHEN h.root IS NULL THEN v ELSE -2147483648 END", "r LEFT JOIN h USING (root)"))
near("valued_regional_minima", lambda r: mo.valued_regional_extrema(r, False), ZONES.format(than="<") + out("CASE WHEN h.root IS NULL THEN v ELSE 2147483647 END", "r LEFT JOIN h USING (root)"))

# Binary and object morphology
PASSES = box(1, 0, "crop", HIGH) + """, a AS (SELECT x, y, {first}(n) AS v FROM w GROUP BY x, y), b AS (SELECT a.x, a.y, {second}(m.v) AS v FROM a JOIN a m ON m.y = a.y AND m.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.x, a.y)"""
near("binary_morphological_opening", lambda r: mo.binary_opening(r, (1, 0)), PASSES.format(first="min", second="max") + out("v", "b"), high)
near("binary_morphological_closing", lambda r: mo.binary_closing(r, (1, 0)), PASSES.format(first="max", second="min") + out("v", "b"), high)
OBJECT = box(1, 1, "crop", HIGH) + """, rim AS (SELECT x, y FROM w GROUP BY x, y HAVING any_value(v) = 1 AND min(n) = 0),
near AS (SELECT DISTINCT q.x, q.y FROM q JOIN rim ON abs(q.x - rim.x) <= 2 AND abs(q.y - rim.y) <= 1)"""
near("dilate_object_morphology", lambda r: mo.dilate_object_morphology(r, (2, 1)), OBJECT + f" SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CASE WHEN near.x IS NOT NULL THEN 1.0::DOUBLE ELSE {HIGH} END AS v FROM q LEFT JOIN near USING (x, y)", high)
near("erode_object_morphology", lambda r: mo.erode_object_morphology(r, (2, 1)), OBJECT + f" SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CASE WHEN near.x IS NOT NULL THEN 0.0::DOUBLE ELSE {HIGH} END AS v FROM q LEFT JOIN near USING (x, y)", high)
FILL = ", h{n} AS (SELECT a.x, a.y, CASE WHEN any_value(a.v) = 0 AND sum(m.v) >= 5 THEN 1 ELSE any_value(a.v) END AS v FROM {of} a, l, (SELECT unnest([-1, 0, 1]) AS dx) i, (SELECT unnest([-1, 0, 1]) AS dy) j, {of} m WHERE m.x = least(greatest(a.x + dx, 0), nx - 1) AND m.y = least(greatest(a.y + dy, 0), ny - 1) GROUP BY a.x, a.y)"
near("voting_binary_iterative_hole_filling", lambda r: mo.voting_iterative_hole_filling(r, (1, 1), 1, 3),
     CELLS + LIMITS + f", h0 AS (SELECT x, y, {HIGH} AS v FROM q)" + "".join(FILL.format(n=k, of=f"h{k - 1}") for k in (1, 2, 3)) + out("v", "h3"), high)
near("neighborhood_connected", lambda r: gr.neighborhood_connected(r, [(4, 4)], 800, 1700, (1, 0)), box(1, 0, "crop") + f""", m AS (SELECT x, y FROM w GROUP BY x, y HAVING min(n) >= 800 AND max(n) <= 1700),
r AS (WITH RECURSIVE reach(x, y) AS (SELECT x, y FROM m WHERE x = 4 AND y = 4 UNION SELECT n.x, n.y FROM reach r, {SIDES} JOIN m n ON n.x = r.x + dx AND n.y = r.y + dy) SELECT * FROM reach)
SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CASE WHEN r.x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM q LEFT JOIN r USING (x, y)""")


# Labels and label maps


def halves(s: SparkSession, d: str) -> Raster:
    """Unit vectors: one of two directions at right angles."""
    r = shades(s, d)
    return Raster(r.df.withColumn("v", F.when(F.col("v") < 2, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))), r.geometry, PIXELS["float64"])


near("vector_connected_component", lambda r: lab.vector_connected_component(r, 0.5), ZONES.format(than=">").replace("FROM q UNION", "FROM p UNION").replace("JOIN q n", "JOIN p n").replace(", r AS (WITH", ", p AS (SELECT x, y, CASE WHEN v % 4 < 2 THEN 0 ELSE 1 END AS v FROM q), r AS (WITH", 1)
     + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(dense_rank() OVER (ORDER BY root) AS DOUBLE) AS v FROM r", halves)
near("threshold_maximum_connected_components", lambda r: lab.threshold_maximum_connected_components(r.map(lambda v: F.floor(v / 100)), 2)[0], None)
table("binary_image_to_label_map", lambda s, d: runs_out(lab.binary_image_to_label_map(high(s, d))), CELLS + REACH.format(near=FACE)
      + ", g2 AS (SELECT *, x - row_number() OVER (PARTITION BY y, label ORDER BY x) AS isl FROM c) SELECT CAST(label AS BIGINT) AS label, CAST(min(x) AS BIGINT) AS x, CAST(y AS BIGINT) AS y, count(*) AS len FROM g2 GROUP BY label, y, isl")
table("label_map_to_binary", lambda s, d: cells(lab.label_map_to_binary(lab.to_label_map(shades(s, d)), quantity(s, d), 7, 2)), cells_sql("CASE WHEN v % 4 <> 0 THEN 7 ELSE 2 END"))


def shifted(runs: DataFrame) -> DataFrame:
    """The runs one column to the left, with other labels, two of which the first map has too."""
    return runs.where("x > 0").select("image_id", (F.col("label") + 1).alias("label"), "y", (F.col("x") - 1).alias("x"), "len")


TWO = CELLS + RUNS + ", two AS (SELECT 0 AS map, label, x, y, len FROM runs UNION ALL SELECT 1 AS map, label + 1, x - 1, y, len FROM runs WHERE x > 0)"
VOXELS = ", vox AS (SELECT map, label, y, unnest(range(x, x + len)) AS x FROM two)"
AGAIN = ", g3 AS (SELECT *, x - row_number() OVER (PARTITION BY y, k ORDER BY x) AS isl FROM (SELECT {distinct} x, y, {k} AS k FROM {of})) SELECT CAST(k AS BIGINT) AS label, CAST(min(x) AS BIGINT) AS x, CAST(y AS BIGINT) AS y, count(*) AS len FROM g3 GROUP BY k, y, isl"


def merged(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        runs = lab.to_label_map(shades(s, d))
        other = shifted(runs)
        if method == "strict":
            other = other.withColumn("label", F.col("label") + 10)
        return runs_out(lab.merge_label_maps([runs, other], method))

    return query


NAMED = "SELECT CAST({label} AS BIGINT) AS label, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(len AS BIGINT) AS len FROM two"
table("merge_label_map_keep", merged("keep"), f"{TWO} " + NAMED.format(label="CASE WHEN map = 0 OR label = 4 THEN label ELSE label + 3 END"))
table("merge_label_map_pack", merged("pack"), f"{TWO} " + NAMED.format(label="CASE WHEN map = 0 THEN label ELSE label + 2 END"))
table("merge_label_map_strict", merged("strict"), f"{TWO} " + NAMED.format(label="CASE WHEN map = 0 THEN label ELSE label + 10 END"))
table("merge_label_map_aggregate", merged("aggregate"), TWO + VOXELS + AGAIN.format(distinct="DISTINCT", k="label", of="vox"))
for _name, _reverse, _best in (("label_unique_label_map", False, "max"), ("label_unique_label_map_reverse", True, "min")):
    table(_name, lambda s, d, r=_reverse: runs_out(lab.label_unique_label_map(lab.to_label_map(shades(s, d)).unionByName(shifted(lab.to_label_map(shades(s, d)))), r)),
          TWO + VOXELS + f", best AS (SELECT x, y, {_best}(label) AS label FROM vox GROUP BY x, y)" + AGAIN.format(distinct="", k="label", of="best"))
PART = "CASE WHEN v >= 1350 THEN 1 + x % 2 ELSE 0 END"


def parts(s: SparkSession, d: str) -> Raster:
    """High cells, labelled by the parity of their column."""
    r = quantity(s, d)
    return r.with_rows(r.df.withColumn("v", F.when(F.col("v") >= 1350, 1 + F.col("x") % 2).otherwise(0)), pixel="uint32")


SHAPE = f"{CELLS}, p AS (SELECT x, y, {PART} AS v FROM q), w AS (SELECT p.x, p.y, p.v, n.v AS n, {{d}} AS d FROM p JOIN p n ON {{d}} < 1)"
OPEN, CLOSED = "pow((p.x - n.x) / 2.5, 2) + pow((p.y - n.y) / 1.5, 2)", "pow(p.x - n.x, 2) / 6.0::DOUBLE + pow(p.y - n.y, 2) / 3.0::DOUBLE"
for _name, _shape, _radius, _spacing in (("", OPEN, (2.5, 1.5), True), ("_voxels", CLOSED, (2, 1), False)):
    near(f"label_set_dilate{_name}", lambda r, k=_radius, u=_spacing: lab.label_set_dilate(r, k, u), SHAPE.format(d=_shape)
         + out("CASE WHEN any_value(v) <> 0 THEN any_value(v) ELSE coalesce(arg_min(n, round(d, 9) * 1000 + n * 1e-7) FILTER (n <> 0), 0) END", "w GROUP BY x, y"), parts)
    near(f"label_set_erode{_name}", lambda r, k=_radius, u=_spacing: lab.label_set_erode(r, k, u), SHAPE.format(d=_shape) + out("CASE WHEN min(n) = max(n) THEN any_value(v) ELSE 0 END", "w GROUP BY x, y"), parts)

# Distances
ALL_PAIRS = CELLS + ", o AS (SELECT x, y FROM q WHERE v >= 1350), d AS (SELECT q.x, q.y, any_value(q.v) AS v, min(pow(q.x - o.x, 2) + pow(q.y - o.y, 2)) AS d FROM q, o GROUP BY q.x, q.y)"
near("danielsson_distance_map", ln.danielsson_distance_map, ALL_PAIRS + out("sqrt(d)", "d"), high)
RIMS = f"{box(1, 1, 'crop', HIGH)}, rim AS (SELECT x, y FROM w {{where}} GROUP BY x, y HAVING any_value(v) = {{inside}} AND {{touch}})"
near("signed_maurer_distance_map", ln.signed_maurer_distance_map, RIMS.format(where="WHERE dx = 0 OR dy = 0", inside=1, touch="min(n) = 0")
     + ", d AS (SELECT q.x, q.y, any_value(q.v) AS v, min(pow(q.x - o.x, 2) + pow(q.y - o.y, 2)) AS d FROM q, rim o GROUP BY q.x, q.y)" + out("CASE WHEN v >= 1350 THEN -sqrt(d) ELSE sqrt(d) END", "d"), high)
near("signed_danielsson_distance_map", ln.signed_danielsson_distance_map, box(1, 1, "crop", HIGH) + """, obj AS (SELECT x, y FROM q WHERE v >= 1350), i AS (SELECT x, y FROM w GROUP BY x, y HAVING min(n) = 0),
a AS (SELECT q.x, q.y, min(pow(q.x - obj.x, 2) + pow(q.y - obj.y, 2)) AS d FROM q, obj GROUP BY q.x, q.y), b AS (SELECT q.x, q.y, min(pow(q.x - i.x, 2) + pow(q.y - i.y, 2)) AS d FROM q, i GROUP BY q.x, q.y)"""
     + out("sqrt(a.d) - sqrt(b.d)", "a JOIN b USING (x, y)"), high)

# Spectra by the sums that define them
PHASE = "2 * pi() * (CAST(k.x * q.x AS DOUBLE) / 12 + CAST(k.y * q.y AS DOUBLE) / ny)"
DFT = CELLS + LIMITS + f" SELECT CAST(k.x AS BIGINT) AS x, CAST(k.y AS BIGINT) AS y, round(sum(q.v * cos({PHASE})), 3) + 0.0 AS re, round(-sum(q.v * sin({PHASE})), 3) + 0.0 AS im FROM q k, q, l {{where}} GROUP BY k.x, k.y"


def complex_cells(r: Raster) -> DataFrame:
    return r.df.select(*[F.col(a).cast("long").alias(a) for a in r.axes], *[(F.round(f"v.{p}", 3) + F.lit(0.0)).alias(p) for p in ("re", "im")])


table("forward_fft", lambda s, d: complex_cells(ln.forward_fft(quantity(s, d))), DFT.format(where=""))
table("real_to_half_hermitian_forward_fft", lambda s, d: complex_cells(ln.half_hermitian_fft(quantity(s, d))[0]), DFT.format(where="WHERE k.x <= 6"))
near("half_hermitian_to_real_inverse_fft", lambda r: ln.half_hermitian_inverse_fft(*ln.half_hermitian_fft(r)).map(lambda v: F.round(v, 4), "float64"), cells_sql("v"))
near("fft_pad", lambda r: ln.fft_pad(r, "zero_flux", 3), None)
near("fft_pad_rows", lambda r: ln.fft_pad(geo.region_of_interest(r, (0, 0), (11, 7)), "zero_flux", 3), CELLS
     + " SELECT CAST(px AS BIGINT) AS x, CAST(py AS BIGINT) AS y, CAST(v AS DOUBLE) AS v FROM (SELECT unnest(range(12)) AS px), (SELECT unnest(range(8)) AS py), q WHERE q.x = least(px, 10) AND q.y = least(py, 6)")


def along_x(s: SparkSession, d: str) -> Raster:
    """A kernel of three voxels along x around voxel 0."""
    r = real(s, d)
    return r.with_rows(r.df.withColumn("v", F.when((F.col("y") == 0) & (F.col("x") == 0), 0.5).when((F.col("y") == 0) & F.col("x").isin(1, 11), 0.25).otherwise(0.0)))


GAIN = "(0.5 + 0.5 * cos(2 * pi() * k / 12))"
INVERSE = CELLS + ", h AS (SELECT d, sum(CASE WHEN {ok} THEN {gain} * cos(2 * pi() * k * d / 12) ELSE 0 END) / 12 AS h FROM (SELECT unnest(range(12)) AS d), (SELECT unnest(range(12)) AS k) GROUP BY d)" + """
SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, round(sum(n.v * h.h), 4) + 0.0 AS v FROM q JOIN q n ON n.y = q.y JOIN h ON h.d = (q.x - n.x + 12) % 12 GROUP BY q.x, q.y"""
four = lambda r: r.map(lambda v: F.round(v, 4), "float64")
table("inverse_deconvolution", lambda s, d: cells(four(dif.inverse_deconvolution(real(s, d), along_x(s, d), 1e-3))), INVERSE.format(ok=f"{GAIN} >= 1e-3", gain=f"1 / {GAIN}"))
table("tikhonov_deconvolution", lambda s, d: cells(four(dif.tikhonov_deconvolution(real(s, d), along_x(s, d), 0.01))), INVERSE.format(ok="true", gain=f"{GAIN} / (pow({GAIN}, 2) + 0.01)"))
ROUND = (", s{n} AS (SELECT x, y, g, v, g - (0.5 * v + 0.25 * coalesce(lag(v) OVER i, last_value(v) OVER t) + 0.25 * coalesce(lead(v) OVER i, first_value(v) OVER t)) AS e FROM e{p} "
         "WINDOW i AS (PARTITION BY y ORDER BY x), t AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),"
         " e{n} AS (SELECT x, y, g, {clip}(v + 0.431729 * (0.5 * e + 0.25 * coalesce(lag(e) OVER i, last_value(e) OVER t) + 0.25 * coalesce(lead(e) OVER i, first_value(e) OVER t)){end}) AS v FROM s{n} "
         "WINDOW i AS (PARTITION BY y ORDER BY x), t AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")  # fmt: skip
for _name, _fn, _clip, _end in (("landweber_deconvolution", dif.landweber, "", ""), ("projected_landweber_deconvolution", dif.projected_landweber, "greatest", ", 0.0")):
    table(_name, lambda s, d, fn=_fn: cells(four(fn(real(s, d).map(lambda v: v - 900), along_x(s, d), 0.431729, 2))), CELLS + ", e0 AS (SELECT x, y, CAST(v - 900 AS DOUBLE) AS g, CAST(v - 900 AS DOUBLE) AS v FROM q)"
          + "".join(ROUND.format(n=k, p=k - 1, clip=_clip, end=_end) for k in (1, 2)) + f" SELECT {CELL}round(v, 4) + 0.0 AS v FROM e2")


# Gaussians: the kernels' weights from their series


def bessel_weights(variance: float, error: float) -> list[float]:
    """e^-t I_k(t) for k from 0 on, until the kernel holds all but ``error``, then normalised."""
    term = lambda k: math.exp(-variance) * sum((variance / 2) ** (2 * j + k) / (math.factorial(j) * math.factorial(j + k)) for j in range(40))
    half = [term(0)]
    while half[0] + 2 * sum(half[1:]) < 1 - error:
        half.append(term(len(half)))
    total = half[0] + 2 * sum(half[1:])
    return [x / total for x in half]


_half = bessel_weights(1.0, 0.01)
_weight = lambda of: f"[{', '.join(f'{x!r}::DOUBLE' for x in _half)}][abs({of}) + 1]"
near("discrete_gaussian", lambda r: ln.discrete_gaussian(r, 1.0), over_box(f"sum(n * {_weight('dx')} * {_weight('dy')})", len(_half) - 1, len(_half) - 1), real)
_slope = lambda of: f"(CASE WHEN {of} - 1 BETWEEN {1 - len(_half)} AND {len(_half) - 1} THEN {_weight(f'({of} - 1)')} ELSE 0 END - CASE WHEN {of} + 1 BETWEEN {1 - len(_half)} AND {len(_half) - 1} THEN {_weight(f'({of} + 1)')} ELSE 0 END) / 2"
near("discrete_gaussian_derivative", lambda r: ln.discrete_gaussian_derivative(r, (1.0, 1.0), (1, 0)), over_box(f"sum(n * {_slope('dx')} * {_weight('dy')})", len(_half), len(_half) - 1), real)
SMOOTH = "sum(n * exp(-(dx * dx + dy * dy) / 0.5::DOUBLE)) / sum(exp(-(dx * dx + dy * dy) / 0.5::DOUBLE))"
near("unsharp_mask", lambda r: ln.unsharp_mask(r, 0.5), over_box(f"any_value(v) + 0.5 * (any_value(v) - {SMOOTH})", 2, 2))

# Diffusion and curvature: chained steps
DIFFUSE = (", d{n} AS (SELECT x, y, v, coalesce(lag(v) OVER i, v) AS a, coalesce(lead(v) OVER i, v) AS b, coalesce(lag(v) OVER j, v) AS c, coalesce(lead(v) OVER j, v) AS d FROM u{p} WINDOW i AS (PARTITION BY y ORDER BY x), j AS (PARTITION BY x ORDER BY y)),"
           " k{n} AS (SELECT sqrt(avg(pow((b - a) / 2, 2) + pow((d - c) / 2, 2))) AS k FROM d{n}),"
           " u{n} AS (SELECT x, y, v + 0.125 * ((a - v) * exp(-pow((a - v) / k, 2) / 2) + (b - v) * exp(-pow((b - v) / k, 2) / 2) + (c - v) * exp(-pow((c - v) / k, 2) / 2) + (d - v) * exp(-pow((d - v) / k, 2) / 2)) AS v FROM d{n}, k{n})")  # fmt: skip
START = CELLS + LIMITS + ", u0 AS (SELECT x, y, CAST(v AS DOUBLE) AS v FROM q)"
near("gradient_anisotropic_diffusion", lambda r: dif.gradient_anisotropic_diffusion(r, iterations=2), START + "".join(DIFFUSE.format(n=k, p=k - 1) for k in (1, 2)) + out("v", "u2"))
_tap = lambda i, j: f"max(m.v) FILTER (dx = {i} AND dy = {j})"
BEND = (", b{n} AS (SELECT a.x, a.y, any_value(a.v) AS v, (" + f"{_tap(1, 0)} - {_tap(-1, 0)}) / 2 AS px, ({_tap(0, 1)} - {_tap(0, -1)}) / 2 AS py, {_tap(1, 0)} - 2 * any_value(a.v) + {_tap(-1, 0)} AS xx, {_tap(0, 1)} - 2 * any_value(a.v) + {_tap(0, -1)} AS yy, "
        f"({_tap(1, 1)} - {_tap(-1, 1)} - {_tap(1, -1)} + {_tap(-1, -1)}) / 4 AS xy" + " FROM u{p} a, l, (SELECT unnest([-1, 0, 1]) AS dx) i, (SELECT unnest([-1, 0, 1]) AS dy) j, u{p} m WHERE m.x = least(greatest(a.x + dx, 0), nx - 1) AND m.y = least(greatest(a.y + dy, 0), ny - 1) GROUP BY a.x, a.y),"
        " k{n} AS (SELECT avg(px * px + py * py) AS k FROM b{n}),"
        " u{n} AS (SELECT x, y, v + {step} * CASE WHEN px * px + py * py < 1e-12 THEN 0 ELSE (xx * py * py - 2 * px * py * xy + yy * px * px) / (px * px + py * py) END{slow} AS v FROM b{n}, k{n})")  # fmt: skip
near("curvature_flow", lambda r: win.curvature_flow(r, 0.05, 2), START + "".join(BEND.format(n=k, p=k - 1, step=0.05, slow="") for k in (1, 2)) + out("v", "u2"))
near("curvature_anisotropic_diffusion", lambda r: dif.curvature_anisotropic_diffusion(r, iterations=2), START + "".join(BEND.format(n=k, p=k - 1, step=0.0625, slow=" * exp(-(px * px + py * py) / (18 * k))") for k in (1, 2)) + out("v", "u2"))


# Orientation: the grid as a volume, ten suppliers to a row


def volume(s: SparkSession, d: str) -> Raster:
    r = quantity(s, d)
    rows = r.df.select("image_id", "x", (F.col("y") % 10).cast("int").alias("y"), F.floor(F.col("y") / 10).cast("int").alias("z"), "v")
    return Raster(rows, Geometry((12, 10, -(-r.geometry.size[1] // 10))), r.pixel)


near("dicom_orient", lambda r: geo.dicom_orient(r, "SRP")[0], CELLS + LIMITS + " SELECT CAST(y // 10 AS BIGINT) AS x, CAST(11 - x AS BIGINT) AS y, CAST(y % 10 AS BIGINT) AS z, CAST(v AS DOUBLE) AS v FROM q", volume)


# Threshold rules over 64 bins: k, middle m, count f, share p, and the share up to the bin
BINS = CELLS + EDGES + """, bg AS (SELECT k, (a + b) / 2 AS m, CAST(f AS DOUBLE) AS f, f / CAST(sum(f) OVER () AS DOUBLE) AS p FROM h),
bs AS (SELECT *, sum(p) OVER w AS lo, 1 - sum(p) OVER w AS hi, sum(f) OVER w AS n1, sum(f * m) OVER w AS m1, sum(f) OVER () AS n, sum(f * m) OVER () AS mm,
  -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) OVER w AS e1, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) OVER () AS e, sum(p * p) OVER w AS q1, sum(p * p) OVER () AS qq FROM bg WINDOW w AS (ORDER BY k))"""
CUT = " SELECT round(m, 6) AS threshold FROM ({scores}) WHERE score IS NOT NULL ORDER BY round(score, 11) DESC, k LIMIT 1"
LIKELY = "lo > 0 AND hi > 1e-12"


def rule(name: str, sql: str) -> None:
    table(f"{name}_threshold", lambda s, d: red.histogram_threshold(quantity(s, d), name, 64)[1].select(F.round("threshold", 6).alias("threshold")), BINS + sql)


rule("isodata", " SELECT round(coalesce((SELECT m FROM bs WHERE f > 0 AND n1 > 0 AND n1 < n AND m >= (m1 / n1 + (mm - m1) / (n - n1)) / 2 ORDER BY k LIMIT 1), (SELECT any_value(mm / n) FROM bs)), 6) AS threshold")
rule("maximum_entropy", CUT.format(scores=f"SELECT k, m, ln(lo) + e1 / lo + ln(hi) + (e - e1) / hi AS score FROM bs WHERE {LIKELY}"))
rule("yen", CUT.format(scores="SELECT k, m, -CASE WHEN q1 > 0 AND k < 63 AND qq - q1 > 0 THEN ln(q1 * (qq - q1)) ELSE 0 END + 2 * CASE WHEN lo * hi > 0 THEN ln(lo * hi) ELSE 0 END AS score FROM bs WHERE k < 63"))
rule("shanbhag", CUT.format(scores=f"""SELECT t.k, any_value(t.m) AS m, -abs(sum(CASE WHEN i.k <= t.k THEN -i.p * ln(greatest(1 - 0.5 * (i.lo - i.p) / t.lo, 1e-300)) * 0.5 / t.lo ELSE 0 END)
  - sum(CASE WHEN i.k > t.k THEN -i.p * ln(greatest(1 - 0.5 * i.hi / t.hi, 1e-300)) * 0.5 / t.hi ELSE 0 END)) AS score FROM bs t, bs i WHERE {LIKELY.replace('lo', 't.lo').replace('hi', 't.hi')} GROUP BY t.k"""))
rule("moments", """, u AS (SELECT sum(p * m) AS a, sum(p * m * m) AS b, sum(p * m * m * m) AS c FROM bs),
v AS (SELECT *, (-b * b + a * c) / (b - a * a) AS c0, (-c + b * a) / (b - a * a) AS c1 FROM u),
z AS (SELECT a, 0.5 * (-c1 - sqrt(greatest(c1 * c1 - 4 * c0, 0))) AS z0, 0.5 * (-c1 + sqrt(greatest(c1 * c1 - 4 * c0, 0))) AS z1 FROM v)
SELECT round(m, 6) AS threshold FROM bs, z WHERE lo > (z1 - a) / (z1 - z0) ORDER BY k LIMIT 1""")
rule("triangle", """, l1 AS (SELECT (SELECT k FROM bs ORDER BY f DESC, k LIMIT 1) AS peak, (SELECT min(k) FROM bs WHERE n1 >= 0.01 * n) AS low, (SELECT max(k) FROM bs WHERE n - n1 + f >= 0.01 * n) AS high),
l2 AS (SELECT *, CASE WHEN peak - low >= high - peak THEN low ELSE peak END AS a, CASE WHEN peak - low >= high - peak THEN peak ELSE high END AS z FROM l1),
l3 AS (SELECT l2.*, (SELECT f FROM bs WHERE k = a) AS fa, (SELECT f FROM bs WHERE k = z) AS fz FROM l2),
best AS (SELECT k FROM bs, l3 WHERE k BETWEEN a AND z ORDER BY round(fa + (fz - fa) / greatest(z - a, 1) * (k - a) - f, 9) DESC, k LIMIT 1)
SELECT round(m, 6) AS threshold FROM bs, best WHERE bs.k = least(best.k + 1, 63)""")
BIN = "(SELECT CASE WHEN {v} < min(a) THEN 0 WHEN {v} >= max(b) THEN 63 ELSE max(k) FILTER (a <= {v}) END FROM h)"
rule("huang", f""", ends AS (SELECT min(k) AS a, max(k) AS z FROM bs WHERE f > 0),
cuts AS (SELECT k AS t FROM bs, ends WHERE k >= a AND k < z),
sides AS (SELECT t, bs.k > t AS side, floor(sum(CASE WHEN bs.k > 0 THEN m * f ELSE 0 END) / sum(f) + 0.5) AS mean FROM cuts, bs GROUP BY 1, 2 HAVING sum(f) > 0),
centred AS (SELECT sides.*, {BIN.format(v="mean")} AS middle FROM sides),
terms AS (SELECT t, f, 1 / (1 + abs(bs.k - middle) / CAST(z - ends.a AS DOUBLE)) AS mu FROM centred, bs, ends WHERE (bs.k > t) = side),
fuzzy AS (SELECT t, sum(CASE WHEN mu < 1 THEN -(mu * ln(mu) + (1 - mu) * ln(1 - mu)) * f ELSE 0 END) AS fz FROM terms GROUP BY t)
SELECT round(m, 6) AS threshold FROM fuzzy JOIN bs ON bs.k = t ORDER BY round(fz, 9), t LIMIT 1""")
rule("li", f""", b AS (SELECT least(min(a), 0) AS shift FROM h),
it AS (WITH RECURSIVE r(n, t, before, cut) AS (SELECT 0, any_value(mm / n), CAST(NULL AS DOUBLE), 0 FROM bs UNION ALL
  SELECT n + 1, trunc(x + CASE WHEN x < 0 THEN -0.5 ELSE 0.5 END) + shift, t, cut FROM (SELECT n, t, shift, cut, (back - fore) / (ln(back) - ln(fore)) AS x FROM (SELECT n, t, shift, cut, coalesce((SELECT sum(f * m) / sum(f) FROM bg WHERE k <= cut), 0) - shift AS back, coalesce((SELECT sum(f * m) / sum(f) FROM bg WHERE k > cut), 0) - shift AS fore
    FROM (SELECT r.n, r.t, {BIN.format(v="trunc(r.t + 0.5)")} AS cut FROM r WHERE r.n < 200 AND (r.before IS NULL OR abs(r.t - r.before) > 0.5)), b))) SELECT * FROM r)
SELECT round(m, 6) AS threshold FROM it JOIN bs ON bs.k = it.cut ORDER BY it.n DESC LIMIT 1""")
rule("kittler_illingworth", f""", it AS (WITH RECURSIVE r(n, t, before) AS (SELECT 0, (SELECT {BIN.format(v="(SELECT any_value(mm / n) FROM bs)")}), -2 UNION ALL
  SELECT n + 1, {BIN.format(v="((lean + sqrt(disc)) / c2)")}, t FROM (SELECT *, lean * lean - c2 * c AS disc FROM (SELECT n, t, 1 / v0 - 1 / v1 AS c2, u0 / v0 - u1 / v1 AS lean, u0 * u0 / v0 - u1 * u1 / v1 + log10(v0 * w1 * w1 / (v1 * w0 * w0)) AS c
    FROM (SELECT n, t, w0, w1, u0, u1, q0 / w0 - u0 * u0 AS v0, q1 / w1 - u1 * u1 AS v1 FROM (SELECT n, t, w0, w1, s0 / w0 AS u0, s1 / w1 AS u1, q0, q1
      FROM (SELECT r.n, r.t, (SELECT sum(f) FROM bg WHERE k <= r.t) AS w0, (SELECT sum(f) FROM bg WHERE k > r.t) AS w1, (SELECT sum(f * m) FROM bg WHERE k <= r.t) AS s0, (SELECT sum(f * m) FROM bg WHERE k > r.t) AS s1,
        (SELECT sum(f * m * m) FROM bg WHERE k <= r.t) AS q0, (SELECT sum(f * m * m) FROM bg WHERE k > r.t) AS q1 FROM r WHERE r.n < 300 AND r.t <> r.before) WHERE w1 > 0)))) WHERE disc > 0) SELECT * FROM r)
SELECT round(m, 6) AS threshold FROM it JOIN bs ON bs.k = it.t ORDER BY it.n DESC LIMIT 1""")

# More chained and circular filters
AROUND = over_box("{value}", 1, 1).split(" SELECT CAST(x")[0] + ", lap AS (SELECT x, y, any_value(v) AS v, sum(n) FILTER (abs(dx) + abs(dy) = 1) - 4 * any_value(v) AS p FROM w GROUP BY x, y)"
near("laplacian_sharpening", win.laplacian_sharpening, AROUND + """, ext AS (SELECT min(v) AS lo, max(v) AS hi, avg(v) AS mean, min(p) AS plo, max(p) AS phi FROM lap),
d AS (SELECT x, y, v - ((p - plo) * ((hi - lo) / CAST(phi - plo AS DOUBLE)) + lo) AS v, lo, hi, mean FROM lap, ext)""" + out("least(greatest(v - (SELECT avg(v) FROM d) + mean, lo), hi)", "d"))
UNIT_OF = "((CAST({0} AS DOUBLE) - lo) / (hi - lo) - 0.5)"
DELTA = f"({UNIT_OF.format('v')} - {UNIT_OF.format('n')})"
near("adaptive_histogram_equalization", lambda r: dif.adaptive_histogram_equalization(r, (2, 2)), box(2, 2) + ", ext AS (SELECT min(v) AS lo, max(v) AS hi FROM q)"
     + out(f"(sum(0.5 * sign({DELTA}) * pow(abs(2 * {DELTA}), 0.3) - 0.15 * sign({DELTA}) * abs(2 * {DELTA}) + 0.3 * {UNIT_OF.format('v')}) / 25 + 0.5) * any_value(hi - lo) + any_value(lo)", "w, ext GROUP BY x, y"), real)
PICK = "list_sort(list(m.v))[CAST(floor(0.5 * (count(*) - 1) + 0.5) AS BIGINT) + 1]"
near("fast_approximate_rank", lambda r: win.fast_approximate_rank(r, (1, 1), 0.5), CELLS + f", a AS (SELECT q.x, q.y, {PICK} AS v FROM q JOIN q m ON m.y = q.y AND abs(m.x - q.x) <= 1 GROUP BY q.x, q.y), b AS (SELECT a.x, a.y, {PICK} AS v FROM a JOIN a m ON m.x = a.x AND abs(m.y - a.y) <= 1 GROUP BY a.x, a.y)" + out("v", "b"))
near("fft_low_pass", lambda r: ln.fft_filter(r, lambda fx, fy: F.exp(-(fx * fx + fy * fy) * 20)), CELLS + LIMITS + """,
hx AS (SELECT d, sum(exp(-20 * pow(least(k, 12 - k) / 12.0::DOUBLE, 2)) * cos(2 * pi() * k * d / 12)) / 12 AS h FROM (SELECT unnest(range(12)) AS d), (SELECT unnest(range(12)) AS k) GROUP BY d),
hy AS (SELECT d, sum(exp(-20 * pow(least(k, ny - k) / CAST(ny AS DOUBLE), 2)) * cos(2 * pi() * k * d / ny)) / any_value(ny) AS h FROM (SELECT unnest(range((SELECT max(y) + 1 FROM q))) AS d), (SELECT unnest(range((SELECT max(y) + 1 FROM q))) AS k), l GROUP BY d),
a AS (SELECT q.x, q.y, sum(n.v * h) AS v FROM q JOIN q n ON n.y = q.y JOIN hx ON hx.d = (q.x - n.x + 12) % 12 GROUP BY q.x, q.y)
SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, round(sum(n.v * h), 6) + 0.0 AS v FROM a q JOIN a n ON n.x = q.x, l JOIN hy ON true WHERE hy.d = (q.y - n.y + ny) % ny GROUP BY q.x, q.y""")
MINMAX = BEND.replace("/ 4 AS xy", "/ 4 AS xy, avg(m.v) AS mean").replace("v + {step} * CASE WHEN px * px + py * py < 1e-12 THEN 0 ELSE (xx * py * py - 2 * px * py * xy + yy * px * px) / (px * px + py * py) END{slow} AS v", "v + CASE WHEN mean < v THEN least({bend}, 0) ELSE greatest({bend}, 0) END AS v")
_bend = "0.05 * CASE WHEN px * px + py * py < 1e-12 THEN 0 ELSE (xx * py * py - 2 * px * py * xy + yy * px * px) / (px * px + py * py) END"
near("min_max_curvature_flow", lambda r: dif.min_max_curvature_flow(r, iterations=2), START + "".join(MINMAX.format(n=k, p=k - 1, bend=_bend) for k in (1, 2)) + out("v", "u2"), real)
near("objectness_measure", dif.objectness_measure, START + BEND.format(n=1, p=0, step=0, slow="") + """, hs AS (SELECT x, y, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS one, (xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS two FROM b1),
bg2 AS (SELECT *, CASE WHEN abs(one) >= abs(two) THEN one ELSE two END AS big, CASE WHEN abs(one) >= abs(two) THEN two ELSE one END AS small FROM hs)"""
     + out("CASE WHEN big < 0 THEN exp(-pow(small / big, 2) / 0.5) * (1 - exp(-(one * one + two * two) / 50)) ELSE 0 END", "bg2"), real)
GROW = """, s{n} AS (SELECT avg(CAST(v AS DOUBLE)) AS m, coalesce(stddev_samp(v), 0) AS d FROM {of}),
m{n} AS (SELECT x, y, v FROM q, s{n} WHERE v BETWEEN s{n}.m - s{n}.d AND s{n}.m + s{n}.d),
r{n} AS (WITH RECURSIVE reach(x, y, v) AS (SELECT x, y, v FROM m{n} WHERE x = 4 AND y = 4 UNION SELECT n.x, n.y, n.v FROM reach r, """ + SIDES + """ JOIN m{n} n ON n.x = r.x + dx AND n.y = r.y + dy) SELECT * FROM reach)"""
near("confidence_connected", lambda r: gr.confidence_connected(r, [(4, 4)], 1.0, 2), CELLS + ", r0 AS (SELECT * FROM q WHERE abs(x - 4) <= 1 AND abs(y - 4) <= 1)" + "".join(GROW.format(n=k, of=f"r{k - 1}") for k in (1, 2, 3))
     + " SELECT CAST(q.x AS BIGINT) AS x, CAST(q.y AS BIGINT) AS y, CASE WHEN r3.x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM q LEFT JOIN r3 USING (x, y)")
