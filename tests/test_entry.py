"""The library used from a process that does not start in the repository."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as driver
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
assert driver.entry(spark).count() == 2
for name in ("knn_within_class", "mlp_generate", "latent_generator", "reconstruct"):
    assert driver.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("all ran")
"""


def test_tasks_need_no_installed_copy(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_cluster_needs_a_shared_folder():
    import pytest

    from skewlens.session import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
