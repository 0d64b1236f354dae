"""Sends the package to the executors where they cannot import it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_archives: list[str] = []


def ship(spark: SparkSession) -> None:
    """Make ``texlake`` importable in Python workers: nothing to do when PYTHONPATH has it, else one addPyFile a session."""
    if str(ROOT) in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    context = spark.sparkContext
    if getattr(context, "_texlake_shipped", False):
        return
    if not _archives:
        base = Path(tempfile.mkdtemp(prefix="texlake-ship-"))
        shutil.copytree(ROOT / "texlake", base / "src/texlake", ignore=shutil.ignore_patterns("__pycache__"))
        _archives.append(shutil.make_archive(str(base / "texlake"), "zip", base / "src"))
    context.addPyFile(_archives[0])
    context._texlake_shipped = True
