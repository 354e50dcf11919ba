"""The entry point with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [(), ("irloom/llm",), ("irloom/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_of_what_is_there(tmp_path, gone):
    for name in ("irloom", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    elsewhere = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and ROOT not in (Path(p).resolve(), *Path(p).resolve().parents)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(elsewhere)}  # else what is gone from the copy is found in the original
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=env)
    assert run.returncode == 0, run.stderr
    whole, own = map(int, run.stdout.split())
    there = (tmp_path / "irloom/llm").is_dir()
    assert whole > 150 and own == (13 if there else 0) + (there and (tmp_path / "corpus_pipeline.py").exists())
