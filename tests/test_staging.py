"""Where intermediate tables go."""

import glob
import os
from types import SimpleNamespace

import pytest

from voxelake import staging


def session(master, path=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: path or default), sparkContext=SimpleNamespace(master=master))


def test_folder_is_the_sessions_own():
    assert staging.shared_dir(session("spark://a:7077", "hdfs://b/c/")) == "hdfs://b/c"
    assert os.path.isdir(staging.shared_dir(session("local[2]")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session("spark://a:7077"))


def test_a_run_cleans_up(spark):
    with staging.run(spark) as path:
        assert staging.staged(spark.range(5)).count() == 5
        assert glob.glob(f"{path.removeprefix('file:')}/*")
    assert not os.path.exists(path.removeprefix("file:"))
    assert staging.staged(spark.range(3)).count() == 3
