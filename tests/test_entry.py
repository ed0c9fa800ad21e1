"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_entry_without_the_corpus_operators(tmp_path, keep_pipeline):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "roadgrain", tmp_path / "roadgrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if keep_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES), len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    same, n, known = said.stdout.split()
    assert same == known == "True" and int(n) > 60
