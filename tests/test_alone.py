"""The engine works without the training-data operators and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_import_without_them(tmp_path):
    for name in ("keelstate", "__spark_entry__.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == 78 and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_outside_imports_them():
    for path in (REPO / "keelstate").rglob("*.py"):
        if "llm" not in path.parts:
            assert "keelstate.llm" not in path.read_text()
