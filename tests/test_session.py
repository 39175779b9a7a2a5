"""A session with no configured folder, started elsewhere, in a process of its own."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
START = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
"""


def run(code, tmp_path):
    (tmp_path / "conf").mkdir(exist_ok=True)
    env = {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path), "HOME": str(tmp_path)}
    env |= {k: os.environ[k] for k in ("JAVA_HOME", "PATH", "SPARK_LOCAL_IP") if k in os.environ}
    done = subprocess.run([sys.executable, "-c", START + code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_tables_are_written_without_a_configured_folder(tmp_path):
    code = """
from riskloom.session import shared_folder, write_out, scratch
with scratch(spark):
    print(write_out(spark.range(5)).count(), shared_folder(spark) == shared_folder(spark))
"""
    assert run(code, tmp_path).split() == ["5", "True"]


def test_tasks_find_the_package_from_another_folder(tmp_path):
    code = """
import __spark_entry__
print(__spark_entry__.queries()["m_smote_counts"](spark, "/root/testdata/sf0.001").count())
"""
    assert run(code, tmp_path).split() == ["2"]


def test_a_cluster_needs_a_shared_folder():
    from riskloom.session import shared_folder

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
