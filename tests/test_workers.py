"""Python-worker steps must not need the package on the workers' path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["archive_entry_audit"](spark, "/root/testdata/sf0.001").count())
"""


def test_worker_functions_ship_by_value(tmp_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_dir, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 50" in out.stdout, out.stderr[-2000:]
