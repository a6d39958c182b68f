"""Making the package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the executors of a session (default: the active one) once, unless their path has it already."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tessera-zip-")) / "tessera.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(at))
    sc._tessera_shipped = True
