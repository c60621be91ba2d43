"""Executors that don't have the package: all queries of operators from another folder, without PYTHONPATH."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

CODE = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name, query in entry.queries().items():
    if name == "pipeline" or name[:2] == "op" and name[2].isdigit() or name in sys.argv[3:]:
        print(name, query(spark, sys.argv[2]).count(), flush=True)
"""


def test_from_another_folder(tmp_path, small):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT / "__spark_entry__.py"), small.replace("sf0.001", "sf0.01")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.rsplit(" ", 1) for line in done.stdout.splitlines() if " " in line)
    assert len(counts) == 14 and all(int(n) > 0 for n in counts.values()), counts
