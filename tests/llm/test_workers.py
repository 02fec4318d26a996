"""Every query runs where only the driver can import the package."""

import os
import subprocess
import sys

from tests.conftest import SF_SMALL

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", sys.argv[1] + "/ckpt").config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").getOrCreate())
import __spark_entry__ as e
from lexidx.llm.queries import QUERIES
for name, query in QUERIES.items():
    try:
        query(spark, {SF_SMALL!r}).write.format("noop").mode("overwrite").save()
    except Exception as x:
        print("FAILED", name, str(x)[-600:])
    else:
        print("RAN", name)
"""


def test_queries_need_no_import_path_on_workers(tmp_dir):
    from lexidx.llm.queries import QUERIES
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, tmp_dir], cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=1200)
    ran = {line.split()[1] for line in out.stdout.splitlines() if line.startswith("RAN ")}
    assert ran == set(QUERIES), out.stdout[-4000:] + out.stderr[-1500:]
