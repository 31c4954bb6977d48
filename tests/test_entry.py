"""The entry point without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "tallyloom", tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_library_never_imports_corpus_subpackage():
    for f in (ROOT / "tallyloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "tallyloom").parts:
            assert "tallyloom.llm" not in f.read_text(), f
