"""The library stands without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_llm(tmp_path):
    for name in ("tidemark", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') and n[2].isdigit()] and len(q) > 50; assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_nothing_else_names_it():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    """Only a local session may fall back to a folder of its own machine."""
    from types import SimpleNamespace

    import pytest

    from tidemark import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.scratch(cluster, "x")
    assert "/x-" in session.scratch(spark, "x")
