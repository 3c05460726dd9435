"""The driver's contract: importable without a session, and without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    env = os.environ | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_import_without_a_session():
    assert "top_level" in names(ROOT)


def test_import_without_the_optional_parts(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "annalist", tmp_path / "annalist", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    got = names(tmp_path)
    assert "top_level" in got and not any(n.startswith("op1_") for n in got) and "pipeline" not in got
