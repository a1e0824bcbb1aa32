"""Workers that have no copy of the package run every operator."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
known = entry.queries()
for name in sorted(known):
    if name.startswith("op") or name in ("pipeline", "s04_gbm_oracle", "j08_index"):
        print(name, known[name](spark, "/root/testdata/sf0.001").count())
print("done")
"""


def test_without_the_package_on_the_workers(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK"))}
    code = SCRIPT.format(root=root, shared=f"file://{tmp_path}/shared")
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0 and run.stdout.strip().endswith("done"), run.stderr[-3000:]
