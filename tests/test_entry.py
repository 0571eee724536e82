"""The entry without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    """A copy of the sources without the two optional folders still lists every other query."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sorted(n for n in q if n == 'pipeline' or n.startswith('op')))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, check=True)
    count, sqls, optional = done.stdout.split(" ", 2)
    assert int(count) >= 218 and int(sqls) >= 200 and optional.strip() == "[]"
