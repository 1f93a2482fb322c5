import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "flagship" in entry.queries()


def test_the_rest_stands_without_the_text_operators(tmp_path):
    for name in ("sievework", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "sievework/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries())); assert 'pipeline' not in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and "flagship" in done.stdout, done.stderr


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "sievework").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text() and "import llm" not in path.read_text(), path
