"""The engine without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_without_the_optional_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (copy / name).unlink()
        out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        queries, oracles, optional = out.stdout.split()
        assert int(queries) >= 60 and int(oracles) >= 60 and optional == "False"
