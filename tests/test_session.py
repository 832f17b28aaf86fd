"""The work folder of sessions with and without a shared folder."""

from __future__ import annotations

import os
import subprocess
import sys

from tallyspark.session import work_dir

BARE = """
from pyspark.sql import SparkSession
from tallyspark.session import work_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first, second = work_dir(spark, "x"), work_dir(spark, "y")
assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
spark.range(3).write.parquet(first)
print("rows", spark.read.parquet(first).count())
"""


def test_bare_local_session_gets_a_folder(tmp_path):
    """Without any defaults of the machine."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", BARE], capture_output=True, text=True, timeout=300, env=env)
    assert "rows 3" in run.stdout, run.stderr[-2000:]


class _Cluster:
    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://somewhere:7077"


def test_a_cluster_without_shared_folder_is_refused():
    try:
        work_dir(_Cluster, "x")
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("a local folder was taken on a cluster")


def test_shared_folder_of_the_session_is_used(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert work_dir(spark, "x").startswith(root.rstrip("/"))
