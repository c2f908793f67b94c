"""Executors hold no copy of this repository: everything that they run must come with the tasks."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

SMALL, ROOT = "/root/testdata/sf0.001", Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sys.path.insert(0, {root!r})  # of the driver alone
import __spark_entry__
for name, plan in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        plan(spark, {small!r}).write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the provided tables")
def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), small=SMALL)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert done.stdout.count("ran ") == 11, done.stderr[-2000:]
