"""The entry without the corpus operators: it must import and offer the rest."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(where):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return set(subprocess.run([sys.executable, "-B", "-c", code], cwd=where, capture_output=True, text=True, check=True).stdout.split())


def test_without_corpus_operators(tmp_path):
    ignored = shutil.ignore_patterns("__pycache__", ".git", "llm", "corpus_pipeline.py", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    left, whole = names(tmp_path / "copy"), names(ROOT)
    assert left and left <= whole and whole - left == {n for n in whole if n == "pipeline" or n.startswith("op") and n[2].isdigit()}
