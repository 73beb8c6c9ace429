"""The entry point, with and without the optional text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_fit():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_text_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    said = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q), set(e.oracle_sql()) <= set(q))"
    run = subprocess.run([sys.executable, "-B", "-W", "ignore", "-c", said], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    n, pipeline, operators, fit = run.stdout.split()[-4:]
    assert int(n) >= 50 and (pipeline, operators, fit) == ("False", "False", "True")
