"""Rasters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..raster import Geometry, Raster, from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suppliers(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] + 1


def by_month(spark: SparkSession, sf_dir: str, value: str = "sum(l_quantity)", pixel: str = "int32", fill: float | None = 0) -> Raster:
    """x: month of shipping (0 to 11), y: supplier key; a cell without rows is ``fill``."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.lit(0).alias("image_id"), (F.month("l_shipdate") - 1).alias("x"), F.col("l_suppkey").alias("y")).agg(F.expr(value).alias("v"))
    return from_table(rows, Geometry((12, _suppliers(spark, sf_dir))), pixel, fill)


def by_hour(spark: SparkSession, sf_dir: str) -> Raster:
    """x: hour of day, y: user, v: number of events (0 without any)."""
    events = table(spark, sf_dir, "events")
    users = events.agg(F.max("user_id")).first()[0] + 1
    rows = events.groupBy(F.lit(0).alias("image_id"), F.hour("ts").alias("x"), F.col("user_id").alias("y")).agg(F.count(F.lit(1)).alias("v"))
    return from_table(rows, Geometry((24, users)), "int32", 0)


def embedding_lines(spark: SparkSession, sf_dir: str) -> Raster:
    """One 1-D image for each vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("x", "v"))
    return from_table(rows, Geometry((64,)), "float64")
