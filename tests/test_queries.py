"""Registered queries against DuckDB at the smallest scale."""

import math
import os
import re

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

#: One or two of each family; the full set is compared by the driver.
NAMES = """log sqrt atan2 divide modulus add_wraps_uint8 cast_uint8_saturates greater xor mask sigmoid vector_magnitude statistics rescale_intensity normalize
median_projection_x standard_deviation_projection_y histogram otsu_threshold hash_image flip slice shrink bin_shrink mirror_pad wrap_pad paste join_series mean
box_sigma median rank gradient_magnitude laplacian zero_crossing grayscale_erode_ball white_top_hat binary_dilate voting_binary connected_component relabel_component
double_threshold binary_fillhole label_statistics label_overlap_measures label_voting label_image_to_label_map change_label_label_map distance_map hausdorff_distance
fft_round_trip resample_translation_linear warp metric_mean_squares metric_neighborhood_correlation label_map_to_rgb label_map_overlay label_map_contour_overlay gaussian_source mha_round_trip png_round_trip
li_threshold huang_threshold kittler_illingworth_threshold vector_connected_component slic_clusters slic_residual bspline_displacement metric_gradient_mean_squares metric_gradient_correlation
metric_gradient_bspline tiff_region compose_displacement_fields displacement_jacobian""".split()


def plain(df):
    cols = sorted(df.columns)

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return cols, sorted(([one(v) for v in t] for t in df[cols].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_meets_sql(spark, con, name):
    got, want = plain(entry.queries()[name](spark, SF).toPandas()), plain(con.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (float, type(None))) for x in a) and None not in a + b else a == b


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert all(re.fullmatch(r"\w+", n) for n in entry.queries())
