"""The driver's contract, without a Spark session and without the llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, 'op1_embedding_near_dedup' in q)"


def said(folder):
    return subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=folder, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.split()


def test_queries_need_no_session():
    assert int(said(ROOT)[0]) > 150


def test_the_rest_stands_alone(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/gradewell", tmp_path / "gradewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, pipeline, op1 = said(tmp_path)
    assert int(n) > 150 and (pipeline, op1) == ("False", "False")
