"""The library and its entry stand without the folders for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), len(o), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


def run(cwd):
    return subprocess.run([sys.executable, "-c", SAYS], cwd=cwd, capture_output=True, text=True, timeout=300)


def test_entry_without_the_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "*.json"))
    shutil.rmtree(copy / "tarnlake" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    for _ in range(2):  # with corpus_pipeline.py and without it
        got = run(copy)
        assert got.returncode == 0 and got.stdout.split()[-2:] == ["False", "False"], got.stderr
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
