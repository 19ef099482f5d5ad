"""The library without its training-data subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def told(folder: Path) -> list[str]:
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_training_data_folders(tmp_path, pipeline):
    gone = {"llm", ".git", "__pycache__"} | (set() if pipeline else {"corpus_pipeline.py"})
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda _, names: [n for n in names if n in gone])
    n, of_llm, sql = told(tmp_path / "copy")
    assert int(n) > 60 and of_llm == "0" and sql == "True"


def test_nothing_else_imports_them():
    outside = [p for p in ROOT.joinpath("evidentia").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert outside and not [p for p in outside if re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M)]
