"""Makes the package importable in Python workers, whatever folder the driver runs in."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless their PYTHONPATH has it."""
    package = Path(__file__).resolve().parent
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    path = Path(tempfile.mkdtemp(prefix="graphloom-code-")) / "graphloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))  # served by the driver to every executor, late ones too
    _done.add(context.applicationId)
