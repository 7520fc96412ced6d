"""The entry module with and without the corpus subpackage."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(folder):
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": folder})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_queries_without_the_corpus_subpackage(scratch):
    shutil.copytree(ROOT, f"{scratch}/repo", ignore=shutil.ignore_patterns(
        "llm", "corpus_pipeline.py", ".git", "__pycache__"))
    rest = _names(f"{scratch}/repo")
    assert "quick_analysis" in rest and not any(n.startswith("op") and n[2:3].isdigit() for n in rest)
    assert "pipeline" not in rest
    assert set(rest) <= set(_names(ROOT))
