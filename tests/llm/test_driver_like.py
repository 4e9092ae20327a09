"""All queries of the subpackage from a fresh process in another folder and time zone, without a package path."""
import os
import subprocess
import sys
import tempfile

SCRIPT = r"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "Asia/Tokyo").getOrCreate())
spec = importlib.util.spec_from_file_location("__spark_entry__", REPO + "/__spark_entry__.py")
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
for name, q in E.queries().items():
    if name == "pipeline" or name.startswith("op"):
        print("ROWS", name, len(q(spark, "/root/testdata/sf0.001").collect()), flush=True)
"""


def test_all_queries_run_anywhere():
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", f"REPO = {repo!r}\n" + SCRIPT], cwd=tempfile.mkdtemp(prefix="seqlab-driver-"), env=env,
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    rows = {line.split()[1]: int(line.split()[2]) for line in out.stdout.splitlines() if line.startswith("ROWS")}
    assert len(rows) == 14 and all(rows.values()), rows
