"""The flagship query in a session with Spark's own defaults: code generation, adaptive execution, 200 partitions."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
print("ROWS", sorted((r.type, r.n) for r in entry.entry(spark).collect()))
"""


def test_entry_with_defaults():
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(Path(__file__).resolve().parents[1])], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    rows = next(x for x in done.stdout.splitlines() if x.startswith("ROWS"))
    assert "incompatible-order" in rows and "G" in rows
