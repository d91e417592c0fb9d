"""Registered queries over the driver tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, pixelwise, reduce, window
from ..sources import tables
from . import alignments, basic, further, spatial, transforms


def queries() -> dict:
    return {name: query for name, (query, _) in {**basic.QUERIES, **spatial.QUERIES, **transforms.QUERIES, **further.QUERIES, **alignments.QUERIES}.items()} | {"flagship": flagship}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in {**basic.QUERIES, **spatial.QUERIES, **transforms.QUERIES, **further.QUERIES, **alignments.QUERIES}.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescale, smooth, threshold, label and measure the shipped quantities."""
    quantity = tables.by_month(spark, sf_dir)
    smooth = window.mean(reduce.rescale_intensity(quantity, 0, 255), (1, 1))
    below, _ = reduce.histogram_threshold(smooth, "otsu", 128)
    components = labels.connected_component(pixelwise.logical_not(below))
    return labels.label_statistics(quantity, components).select("label", "count", "minimum", "maximum", F.round("mean", 6).alias("mean"), "sum")
