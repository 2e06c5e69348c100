"""The entry must load in a fresh process, before Spark starts, from any working folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

PROBE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
names, oracles = e.queries(), e.oracle_sql()
assert len(names) >= 197 and set(oracles) <= set(names)
sys.path.remove({str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
print("ROWS", names["top_01_dictionary_suggestions" if "top_01_dictionary_suggestions" in names else sorted(n for n in names if n.startswith("top_01"))[0]](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_loads_without_session_and_udfs_run_elsewhere(tmp_path):
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "ROWS" in done.stdout
