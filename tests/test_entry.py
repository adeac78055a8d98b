"""The driver's entry point, also where the training-data subpackage is gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "cairnstore"):
        there = os.path.join(ROOT, name)
        if os.path.isdir(there):
            shutil.copytree(there, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(there):
            shutil.copy(there, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q), set(o) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    count, *rest = out.stdout.split()
    assert int(count) >= 66 and rest == ["False", "False", "True"]
