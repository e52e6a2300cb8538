"""The entry module with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from checks.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; print(sorted(e.queries()) == {names!r}, sorted(set(e.oracle_sql()) - set({names!r})))"


@pytest.mark.parametrize("gone", [("tallyhouse/llm", "tests/llm"), ("tallyhouse/llm", "tests/llm", "corpus_pipeline.py"), ("tallyhouse/llm/*.py", "tests/llm")])
def test_the_rest_stands_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    leave_out = [Path(g).name for g in gone if "*" not in g]
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: {n for n in names if n in (".git", "__pycache__") or n in leave_out})
    if "tallyhouse/llm/*.py" in gone:
        (copy / "tallyhouse" / "llm").mkdir(exist_ok=True)  # an empty folder left behind
        for file in (copy / "tallyhouse" / "llm").glob("*.py"):
            file.unlink()
    told = subprocess.run([sys.executable, "-c", NAMES.format(root=str(copy), names=sorted(QUERIES))], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert told.stdout.strip() == "True []"


def test_nothing_of_the_rest_imports_llm():
    files = [f for folder in ("tallyhouse", "checks", "tests") for f in (ROOT / folder).rglob("*.py") if "llm" not in f.relative_to(ROOT).parts]
    assert files and not [f for f in files if "tallyhouse.llm" in f.read_text() and f.name != Path(__file__).name]
