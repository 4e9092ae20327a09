"""Driver-like run: a fresh process in another folder, a plain session in another
time zone, queries that ship Python code to executors."""
import os
import subprocess
import sys
import tempfile

SCRIPT = r'''
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "Asia/Tokyo").getOrCreate())
spec = importlib.util.spec_from_file_location("__spark_entry__", REPO + "/__spark_entry__.py")
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
q = E.queries()
print("ENTRY", E.entry(spark).count())
print("PVALUES", q["did_pvalues"](spark, "/root/testdata/sf0.01").count())
print("LOGIT", q["correct_fe_logit"](spark, "/root/testdata/sf0.001").count())
'''


def test_entry_and_python_side_queries_from_other_folder():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    d = tempfile.mkdtemp(prefix="seqlab-driver-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", f"REPO = {repo!r}\n" + SCRIPT], cwd=d, env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = dict(line.split() for line in out.stdout.splitlines() if line.split()[0] in ("ENTRY", "PVALUES", "LOGIT"))
    assert int(lines["ENTRY"]) > 0 and int(lines["PVALUES"]) == 6 and int(lines["LOGIT"]) == 1
