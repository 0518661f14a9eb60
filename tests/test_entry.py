"""The driver's contract: it holds with every part, with a dependency missing, and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *e.queries())"


def said(code: str, cwd: str) -> list[str]:
    run = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=os.environ | {"PYTHONPATH": cwd}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def core_names() -> set[str]:
    from tessera.plans import core

    return set(core.QUERIES)


def test_all_parts():
    names = set(said(SAY, ROOT)[2:])
    assert core_names() <= names
    if os.path.isdir(f"{ROOT}/tessera/llm"):
        assert "pipeline" in names and len([n for n in names if n.startswith("op")]) == 10


@pytest.mark.parametrize("missing", ["ahocorasick", "tokenizers", "public_tokenizers", "xxhash"])
def test_missing_dependency(missing):
    """A dependency that cannot be imported costs the queries that need it, not the others."""
    names = set(said(f"import sys; sys.modules[{missing!r}] = None; {SAY}", ROOT)[2:])
    assert core_names() <= names


def test_without_training_data_operators(tmp_path):
    """Both folders and the pipeline deleted: the rest imports, and its tests are found."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.md", "*.json"))
    at = str(tmp_path / "repo")
    assert set(said(SAY, at)[2:]) == core_names()
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=at, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0, found.stdout
    run = subprocess.run([sys.executable, "-m", "pytest", "tests/test_core.py", "-q", "-k", "test_self_test_context or test_topk"], cwd=at, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stdout
