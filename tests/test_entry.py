"""The entry file with and without the training-data part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def test_entry_without_training_data_operators(tmp_path):
    for name in ("quarry", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    done = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    queries, sql = (line.split() for line in done.stdout.splitlines()[-2:])
    assert "describe" in queries and set(sql) <= set(queries)
    assert not [q for q in queries if q.startswith("op") and q[2:3].isdigit() or q == "pipeline"]
