"""The core stands alone: without the text-preparation folders every other query and test still works."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); print(*sorted(q))"


@pytest.mark.parametrize("also_pipeline", [False, True])
def test_without_the_text_operators(tmp_path, also_pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "spark-warehouse", *(["corpus_pipeline.py"] if also_pipeline else [])))
    assert (copy / "corpus_pipeline.py").exists() is not (also_pipeline or not os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")))
    got = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, capture_output=True, text=True, check=False, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.returncode == 0, got.stderr
    names = got.stdout.split()
    assert "audit_references" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
