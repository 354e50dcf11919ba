"""Send this package to the Python workers of a session that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Once a context: nothing if workers inherit a path to the package (PYTHONPATH; in local mode the working folder too)."""
    sc = spark.sparkContext
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.master.startswith("local[") or sc.master == "local":
        inherited.append(Path.cwd().resolve())
    if ROOT in inherited or getattr(sc, "_irloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "irloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "irloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
        if (ROOT / "corpus_pipeline.py").exists():
            z.write(ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
    sc.addPyFile(str(archive))
    sc._irloom_shipped = True
