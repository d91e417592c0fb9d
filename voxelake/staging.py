"""Staging of intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: The folders of the runs that are open, the innermost last.
_runs: list[str] = []


@lru_cache(1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="voxelake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder of its own (tests); on a
    cluster that would lose data, so it is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside this block share one folder, which goes when the block ends.

    Results are lazy and read these tables, so write them before the block ends.
    """
    path = f"{shared_dir(spark)}/voxelake/run-{uuid.uuid4().hex}"
    _runs.append(path)
    try:
        yield path
    finally:
        _runs.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later stages
    survive the loss of executors and never recompute it."""
    spark = df.sparkSession
    path = f"{_runs[-1] if _runs else shared_dir(spark) + '/voxelake'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
