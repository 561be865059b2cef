"""Queries run when the workers cannot see the repository: another working folder, and a
session that somebody else has made."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", len(e.entry(spark).collect()))
for name in ("embed_chunks", "vector_search", "stream_assemble"):
    print(name, len(e.queries()[name](spark, e.SMOKE_DIR).collect()))
"""


def test_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.rsplit(" ", 1) for line in done.stdout.split("\n") if " " in line)
    assert len(counts) == 4 and all(int(n) > 0 for n in counts.values())
