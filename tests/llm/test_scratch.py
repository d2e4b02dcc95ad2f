"""Scratch tables: in one folder of the application, which is gone after it."""

import os
import subprocess
import sys

APPLICATION = """
import os, sys
from pyspark.sql import SparkSession
from sparrel.llm.common import drop_table, materialise
at = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + at).getOrCreate()
a, b = (materialise(spark.range(9), label) for label in "ab")
(own,) = [f for f in os.listdir(at) if f.startswith("sparrel-")]  # Spark has a folder of its own there
assert not [f for f in os.listdir(at) if f.startswith(("a-", "b-"))] and len(os.listdir(f"{at}/{own}")) == 2
drop_table(a)
assert len(os.listdir(f"{at}/{own}")) == 1 and b.count() == 9
spark.stop()
print("done")
"""


def test_scratch_tables_go_with_the_application(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "shared").mkdir()
    env = os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    out = subprocess.run([sys.executable, "-c", APPLICATION, str(tmp_path / "shared")], env=env, capture_output=True, text=True, timeout=120)
    assert "done" in out.stdout, out.stderr[-2000:]
    assert [f for f in os.listdir(tmp_path / "shared") if f.startswith("sparrel-")] == []
