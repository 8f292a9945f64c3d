"""The entry points work with and without the training-data part."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_training_data_part(tmp_path):
    copy = tmp_path / "repo"
    skipped = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests", "__pycache__")
    shutil.copytree(REPO, copy, ignore=skipped)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    n_queries, n_oracles, pipeline = done.stdout.split()
    assert int(n_queries) == int(n_oracles) >= 48 and pipeline == "False"


def test_nothing_else_imports_the_training_data_part():
    others = [p for p in (REPO / "encaudit").rglob("*.py") if "llm" not in p.parts]
    others += [p for p in (REPO / "registry").rglob("*.py")] + [REPO / "bench.py"]
    assert not [p for p in others if "encaudit.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
