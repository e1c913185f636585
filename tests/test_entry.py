"""The driver's entry with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and len(q) > 50; print(sorted(x for x in q if x == 'pipeline' or x.startswith('op')))"


@pytest.mark.parametrize("gone", [("graphloom/llm", "tests/llm"), ("graphloom/llm", "tests/llm", "corpus_pipeline.py"), ("graphloom/llm/registry.py",)])
def test_queries_without_the_training_data_folders(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(g) for g in gone)))
    for name in ("graphloom/llm", "tests/llm"):
        if name in gone:
            assert not (tmp_path / "repo" / name).exists()
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / "repo", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "[]"
