"""The entry module from another folder, where tasks cannot import the code."""

import os
import subprocess
import sys
import tempfile

SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {path!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("V01_embed_column", "V04_vector_top_k", "E03_judge_misses"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(path=path)], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=240
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert "V01_embed_column 200" in run.stdout
