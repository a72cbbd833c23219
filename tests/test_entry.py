"""The entry module imports, and Python functions run, far from the repository folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _python(code: str, cwd, **env) -> subprocess.CompletedProcess:
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=clean | env, capture_output=True, text=True,
                          timeout=600)


def test_entry_imports_without_jars(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import builtins, glob, zipfile
def no(*a, **k): raise AssertionError("reads a jar")
zipfile.ZipFile = no; glob.glob = no
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""
    out = _python(code, tmp_path)
    assert out.returncode == 0, out.stderr[-2000:]
    n, sql = map(int, out.stdout.split()[-2:])
    assert n >= 100 and sql >= 90


def test_python_functions_run_from_a_foreign_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
     .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
print(e.queries()["detect_anomalies"](s, "/root/testdata/sf0.001").count())
"""
    out = _python(code, tmp_path)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) > 0
