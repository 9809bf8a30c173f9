"""The entry points with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidegraph.plans import catalog


def test_all_queries_are_found():
    names = set(entry.queries())
    assert set(catalog.QUERIES) <= names and set(entry.oracle_sql()) <= names


def test_without_text_operators(monkeypatch):
    gone = ("tidegraph.llm", "corpus_pipeline")
    monkeypatch.setattr(entry, "find_spec", lambda name: None if name.startswith(gone) else object())
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert entry.oracle_sql() == catalog.ORACLES


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_in_a_tree_without_their_files(tmp_path, pipeline_stays):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidegraph", tmp_path / "tidegraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline_stays else [])]:
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "False"], done.stderr
